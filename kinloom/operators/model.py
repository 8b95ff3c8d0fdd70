"""Gradient boosted trees on pair features: training, scores, importance and ablations."""

from __future__ import annotations

from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SEED = 42


def assemble(features: DataFrame, names: list[str]) -> DataFrame:
    return VectorAssembler(inputCols=names, outputCol="__features").transform(features)


def train(features: DataFrame, names: list[str], trees: int = 600, depth: int = 7, weight: str | None = None, validation: str | None = None) -> GBTClassificationModel:
    """Boosting with step 0.05 and 0.85 of rows and features a tree; stops early on the ``validation`` rows."""
    gbt = GBTClassifier(featuresCol="__features", labelCol="label", maxIter=trees, stepSize=0.05, maxDepth=min(depth, 30), subsamplingRate=0.85, featureSubsetStrategy="0.85", seed=SEED)
    if weight:
        gbt = gbt.setWeightCol(weight)
    if validation:
        gbt = gbt.setValidationIndicatorCol(validation)
    return gbt.fit(assemble(features, names))


def score(model: GBTClassificationModel, features: DataFrame, names: list[str]) -> DataFrame:
    """``features`` with ``score``, the probability of a match."""
    out = model.transform(assemble(features, names))
    return out.withColumn("score", vector_to_array("probability")[1]).drop("__features", "rawPrediction", "probability", "prediction")


def importance(model: GBTClassificationModel, names: list[str], spark) -> DataFrame:
    """feature, gain in percent of all."""
    values = model.featureImportances.toArray()
    total = float(values.sum()) or 1.0
    return spark.createDataFrame([(n, 100.0 * float(v) / total) for n, v in zip(names, values, strict=True)], "feature string, gain double")


def ablation(features: DataFrame, sets: dict[str, list[str]], s1: DataFrame, truth: DataFrame, thresholds: list[float], trees: int = 20, depth: int = 4, equal: DataFrame | None = None, sweep=None) -> DataFrame:
    """model, n_features, threshold, macro_f05: each feature set trained, swept, and its best threshold kept.

    With ``equal`` it is trained on those rows, weighed by ``times``; ``sweep`` (scores, thresholds) may stand in for that over ``s1`` and ``truth``.
    """
    from kinloom.operators import evaluate

    sweep = sweep or (lambda scores, grid: evaluate.sweep(s1, scores, truth, grid))

    out = None
    for name, columns in sets.items():
        fitted = train(features, columns, trees, depth) if equal is None else train(equal, columns, trees, depth, "times")
        best = sweep(score(fitted, features, columns), thresholds).agg(F.max(F.struct("macro_f05", (-F.col("threshold")).alias("neg"))).alias("b"))
        row = best.select(F.lit(name).alias("model"), F.lit(len(columns)).alias("n_features"), (-F.col("b.neg")).alias("threshold"), F.col("b.macro_f05").alias("macro_f05"))
        out = row if out is None else out.unionByName(row)
    return out
