"""A corpus from raw documents to packed sequences: STAGES in order, each one operator of ``kinloom.llm``.

Each stage takes (spark, docs, sf_dir) and works on all rows it is given; all but the last return the
columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinloom.llm import bpe, jaccard_join, language, packing, quality, secret_scan
from kinloom.llm.store import keep, small
from kinloom.shipping import shipped

#: A document of whose 3-grams the landmarks of all languages know a smaller share is in none of these languages.
#: Scores can't tell: over the languages they sum to 1, so the best of L is 1 / L at least for any text.
LEAST_KNOWN = 0.8


def _rows(docs: DataFrame, *needed: str) -> DataFrame:
    """Each row whole beside the columns that an operator needs, so that nothing an operator adds meets a column of the same name."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__row"), *needed)


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter, and those whose n-grams no learned language has, go.

    Without any labelled document nothing can be told, and only documents without a letter go.
    """
    model = language.train(docs)
    found = language.identify(_rows(docs, "text"), model, known="__known")
    if not model.languages:
        kept = found.filter(F.coalesce(F.col("text"), F.lit("")).rlike(r"\p{L}"))
    else:
        kept = found.filter((F.col("lang_pred") != language.UNDETERMINED) & (F.col("__known") >= LEAST_KNOWN))
    return kept.select("__row.*")


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail a rule of the current policy go."""
    return quality.with_policy(quality.ledger(_rows(docs, "text")), name="__kept").filter("__kept").select("__row.*")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near copies (five words, 0.8) its smallest doc_id stays, in one row; rows without doc_id stay."""
    groups = jaccard_join.join(docs)
    gone = keep(groups.filter(F.col("component_id") != F.col("doc_id")).select("doc_id").distinct(), "gone")
    left = docs.join(small(gone), "doc_id", "left_anti").select(*docs.columns)
    several = keep(groups.groupBy("doc_id").agg(F.count("*").alias("n")).filter("n > 1 AND doc_id IS NOT NULL").select("doc_id"), "several")
    if several.isEmpty():
        return left
    again = small(several)
    row = F.min_by(F.struct(*[F.col(f"`{c}`") for c in docs.columns]), F.struct(F.col("text").isNull(), "text")).alias("__row")
    one = left.join(again, "doc_id", "left_semi").groupBy("doc_id").agg(row).select("__row.*")
    return left.join(again, "doc_id", "left_anti").union(one)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Found secrets are replaced by a mark in the text, and n_chars follows it; every document stays."""
    cleaned = secret_scan.clean(secret_scan.scan(docs, secret_scan.train(spark), out="__findings"), findings="__findings")
    changed = F.size("__findings") > 0
    if "n_chars" in docs.columns:
        cleaned = cleaned.withColumn("n_chars", F.when(changed, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return cleaned.select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the packed sequences."""
    return packing.pack(docs, bpe.default_vocabulary())


STAGES = [
    ("language ID", shipped(language_id)),
    ("quality rules", shipped(quality_rules)),
    ("n-gram Jaccard join", shipped(near_duplicates)),
    ("secret scans", shipped(secrets)),
    ("packing", shipped(pack)),
]

#: SQL can express neither the first stage nor the last; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each stage's rows are written to the shared folder and read again, so that none is computed twice."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = keep(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
