"""Evaluation: blocking quality, per-entity precision and recall, threshold sweeps, and profiling."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kinloom.store import keep

#: Cells of scores, each of which one task orders.
CELLS = 256


def blocking_metrics(s1: DataFrame, pairs: DataFrame, truth: DataFrame) -> DataFrame:
    """Per strategy: candidates, their mean, median and largest number per S1, S1 without any, pair and entity recall.

    ``s1`` (s1), ``pairs`` (strategy, s1, target) and ``truth`` (s1, target); pairs count once a strategy.
    """
    pairs = pairs.select("strategy", "s1", "target").distinct()
    counts = pairs.groupBy("strategy", "s1").agg(F.count("*").alias("n")).groupBy("strategy", "n").agg(F.count("*").alias("times"))
    found = pairs.join(truth.distinct(), ["s1", "target"]).groupBy("strategy").agg(F.count("*").alias("found"), F.countDistinct("s1").alias("entities"))
    total = truth.distinct().agg(F.count("*").alias("pairs"), F.countDistinct("s1").alias("linked"))
    return _blocking(s1, counts, found, total)


def blocking_counts(s1: DataFrame, tally: DataFrame, truth: DataFrame) -> DataFrame:
    """``blocking_metrics`` of the numbers (strategy, n, found, times) of candidates and true ones among them; ``truth`` the same of the true pairs."""
    counts = tally.groupBy("strategy", "n").agg(F.sum("times").alias("times"))
    found = tally.filter("found > 0").groupBy("strategy").agg(F.sum(F.col("found") * F.col("times")).alias("found"), F.sum("times").alias("entities"))
    total = truth.agg(F.coalesce(F.sum(F.col("n") * F.col("times")), F.lit(0)).alias("pairs"), F.coalesce(F.sum("times"), F.lit(0)).alias("linked"))
    return _blocking(s1, counts, found, total)


def _blocking(s1: DataFrame, counts: DataFrame, found: DataFrame, total: DataFrame) -> DataFrame:
    # S1 records without candidates are one more row a strategy, not a row each.
    every = F.broadcast(s1.agg(F.countDistinct("s1").alias("every")))
    none = counts.groupBy("strategy").agg(F.sum("times").alias("some")).join(every).select("strategy", F.lit(0).cast("long").alias("n"), (F.col("every") - F.col("some")).alias("times"))
    full = counts.union(none).filter("times > 0")
    sizes = full.groupBy("strategy").agg(
        F.sum(F.col("n") * F.col("times")).alias("candidates"),
        (F.sum(F.col("n") * F.col("times")) / F.sum("times")).alias("mean"),
        F.percentile("n", 0.5, F.col("times")).alias("median"),
        F.max("n").alias("most"),
        F.sum(F.when(F.col("n") == 0, F.col("times")).otherwise(0)).alias("without"),
    )
    out = sizes.join(found, "strategy", "left").join(F.broadcast(total))
    part = lambda a, b: F.when(F.col(b) > 0, F.coalesce(F.col(a), F.lit(0)) / F.col(b)).otherwise(0.0)
    return out.select("strategy", "candidates", "mean", "median", "most", "without", part("found", "pairs").alias("pair_recall"), part("entities", "linked").alias("entity_recall"))


def with_unions(pairs: DataFrame, unions: dict[str, list[str]]) -> DataFrame:
    """``pairs`` with the strategies of each union once more under its name."""
    named = F.create_map(*[x for name, members in unions.items() for x in (F.lit(name), F.array(*map(F.lit, members)))])
    each = F.explode(F.concat(F.array("strategy"), F.filter(F.map_keys(named), lambda k: F.array_contains(named[k], F.col("strategy")))))
    return pairs.select(each.alias("strategy"), "s1", "target").distinct()


def recovered(pairs: DataFrame, truth: DataFrame, old: list[str]) -> DataFrame:
    """strategy, recovered: true pairs that a strategy finds and no old one does."""
    hit = pairs.select("strategy", "s1", "target").distinct().join(truth.distinct(), ["s1", "target"])
    known = hit.filter(F.col("strategy").isin(old)).select("s1", "target").distinct()
    return hit.filter(~F.col("strategy").isin(old)).join(known, ["s1", "target"], "left_anti").groupBy("strategy").agg(F.count("*").alias("recovered"))


def per_entity(s1: DataFrame, predicted: DataFrame, truth: DataFrame, beta: float = 0.5) -> DataFrame:
    """s1, tp, fp, fn, n_true, precision, recall, f, exact.

    An entity without truth scores 1 without predictions and 0 with any; one with truth and no hit scores 0.
    """
    marked = predicted.select("s1", "target", F.lit(1).alias("p")).distinct().join(truth.select("s1", "target", F.lit(1).alias("t")).distinct(), ["s1", "target"], "full")
    tally = marked.groupBy("s1").agg(F.count_if(F.col("p").isNotNull() & F.col("t").isNotNull()).alias("tp"), F.count_if(F.col("t").isNull()).alias("fp"), F.count_if(F.col("p").isNull()).alias("fn"))
    full = s1.select("s1").distinct().join(tally, "s1", "left").na.fill(0, ["tp", "fp", "fn"])
    tp, fp, fn, b = F.col("tp"), F.col("fp"), F.col("fn"), beta * beta
    none = tp + fn == 0
    p = F.when(tp + fp > 0, tp / (tp + fp)).otherwise(F.when(none, 1.0).otherwise(0.0))
    r = F.when(tp + fn > 0, tp / (tp + fn)).otherwise(F.when(fp == 0, 1.0).otherwise(0.0))
    f = F.when(none, F.when(fp == 0, 1.0).otherwise(0.0)).when(tp == 0, 0.0).otherwise((1 + b) * tp / ((1 + b) * tp + b * fn + fp))
    return full.select("s1", "tp", "fp", "fn", (tp + fn).alias("n_true"), p.alias("precision"), r.alias("recall"), f.alias("f"), F.when((fp == 0) & (fn == 0), 1).otherwise(0).alias("exact"))


def macro(entities: DataFrame) -> DataFrame:
    """One row: entities, macro means, exact matches, singleton accuracy and false positives, pair precision and recall."""
    single = F.col("n_true") == 0
    rate = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    tp, fp, fn = F.sum("tp"), F.sum("fp"), F.sum("fn")
    return entities.agg(
        F.count("*").alias("entities"),
        F.avg("f").alias("macro_f"),
        F.avg("precision").alias("macro_precision"),
        F.avg("recall").alias("macro_recall"),
        F.avg("exact").alias("exact_rate"),
        rate(F.count_if(single & (F.col("fp") == 0)), F.count_if(single)).alias("singleton_accuracy"),
        rate(F.count_if(single & (F.col("fp") > 0)), F.count_if(single)).alias("singleton_fp_rate"),
        tp.alias("tp"),
        fp.alias("fp"),
        fn.alias("fn"),
        rate(tp, tp + fp).alias("pair_precision"),
        rate(tp, tp + fn).alias("pair_recall"),
        F.avg("fp").alias("mean_fp"),
        F.avg("fn").alias("mean_fn"),
    )


def candidate_stats(s1: DataFrame, pairs: DataFrame, truth: DataFrame) -> DataFrame:
    """One row: candidate recall, and mean, median, 95th and 99th percentile, most and none of candidates per s1."""
    n = s1.select("s1").distinct().join(pairs.select("s1", "target").distinct().groupBy("s1").agg(F.count("*").alias("n")), "s1", "left").na.fill(0, ["n"])
    hit = truth.distinct().join(pairs.select("s1", "target").distinct().withColumn("hit", F.lit(1)), ["s1", "target"], "left").agg(F.coalesce(F.avg(F.coalesce("hit", F.lit(0))), F.lit(0.0)).alias("recall"))
    return _spread(n.groupBy("n").agg(F.count("*").alias("times"))).join(F.broadcast(hit))


def candidate_counts(s1: DataFrame, tally: DataFrame, truth: DataFrame) -> DataFrame:
    """``candidate_stats`` of the numbers (n, found, times) of candidates and true ones among them; ``truth`` the same of the true pairs."""
    n, times = F.col("n"), F.col("times")
    every = s1.agg(F.countDistinct("s1").alias("every"))
    some = tally.agg(F.coalesce(F.sum("times"), F.lit(0)).alias("some"))
    none = every.join(F.broadcast(some)).select(F.lit(0).cast("long").alias("n"), (F.col("every") - F.col("some")).alias("times"))
    true = truth.agg(F.coalesce(F.sum(n * times), F.lit(0)).alias("true"))
    hit = tally.agg(F.coalesce(F.sum(F.col("found") * times), F.lit(0)).alias("hit")).join(F.broadcast(true)).select(F.when(F.col("true") > 0, F.col("hit") / F.col("true")).otherwise(0.0).alias("recall"))
    return _spread(tally.groupBy("n").agg(F.sum("times").alias("times")).union(none).filter("times > 0")).join(F.broadcast(hit))


def _spread(counts: DataFrame) -> DataFrame:
    """candidates, mean, median, p95, p99, most and without, of the rows n, times."""
    n, times = F.col("n"), F.col("times")
    return counts.agg(
        F.sum(n * times).alias("candidates"), (F.sum(n * times) / F.sum(times)).alias("mean"), *[F.percentile("n", p, times).alias(name) for name, p in (("median", 0.5), ("p95", 0.95), ("p99", 0.99))],
        F.max("n").alias("most"), F.coalesce(F.sum(F.when(n == 0, times)), F.lit(0)).alias("without"),
    )


def sweep(s1: DataFrame, scored: DataFrame, truth: DataFrame, thresholds: list[float]) -> DataFrame:
    """One row a threshold: macro F, pair precision and recall, exact and singleton rates, predictions per s1."""
    known = truth.select("s1", "target", F.lit(1).alias("t")).distinct()
    hits = scored.select("s1", "target", "score").join(known, ["s1", "target"], "left")
    tally = hits.select("s1", "t", _reached(thresholds)).groupBy("threshold", "s1").agg(F.count_if(F.col("t").isNotNull()).alias("tp"), F.count_if(F.col("t").isNull()).alias("fp"))
    base = s1.select("s1").distinct().join(known.groupBy("s1").agg(F.count("*").alias("n_true")), "s1", "left").na.fill(0, ["n_true"])
    return _swept(tally, base.withColumn("times", F.lit(1)), thresholds)


def sweep_classes(sizes: DataFrame, scored: DataFrame, thresholds: list[float]) -> DataFrame:
    """``sweep`` of classes of records: ``sizes`` (s1, times, n_true of each), ``scored`` (s1, label, score, n2 targets)."""
    of = lambda k: F.sum(F.when(F.col("label") == k, F.col("n2")).otherwise(0))
    return _swept(scored.select("s1", "label", "n2", _reached(thresholds)).groupBy("threshold", "s1").agg(of(1).alias("tp"), of(0).alias("fp")), sizes, thresholds)


def _reached(thresholds: list[float]):
    return F.explode(F.filter(F.array(*map(F.lit, thresholds)), lambda t: t <= F.col("score"))).alias("threshold")


def _swept(tally: DataFrame, base: DataFrame, thresholds: list[float]) -> DataFrame:
    tp, fp, n, times = F.col("tp"), F.col("fp"), F.col("n_true"), F.col("times")
    f = F.when(n == 0, F.when(fp == 0, 1.0).otherwise(0.0)).when(tp == 0, 0.0).otherwise(1.25 * tp / (1.25 * tp + 0.25 * (n - tp) + fp))
    if_ = lambda c: F.coalesce(F.sum(F.when(c, times)), F.lit(0))
    some = tally.join(base, "s1").groupBy("threshold").agg(F.sum(f * times).alias("f"), F.sum(tp * times).alias("tp"), F.sum(fp * times).alias("fp"), if_(n == 0).alias("wrong"), if_((n > 0) & (fp == 0) & (tp == n)).alias("right"))
    # What holds for entities without predictions follows from the totals: right if a singleton, else 0.
    total = base.agg(F.coalesce(F.sum(times), F.lit(0)).alias("entities"), F.sum(n * times).alias("links"), if_(n == 0).alias("singletons"))
    grid = total.select("*", F.explode(F.array(*map(F.lit, thresholds))).alias("threshold"))
    full = grid.join(some, "threshold", "left").na.fill(0, ["f", "tp", "fp", "wrong", "right"])
    c = F.col
    rate = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    return full.select(
        "threshold",
        rate(c("f") + c("singletons") - c("wrong"), c("entities")).alias("macro_f05"),
        rate(c("tp"), c("tp") + c("fp")).alias("pair_precision"),
        rate(c("tp"), c("links")).alias("pair_recall"),
        rate(c("wrong"), c("singletons")).alias("singleton_fp_rate"),
        rate(c("tp") + c("fp"), c("entities")).alias("avg_predictions"),
        rate(c("right") + c("singletons") - c("wrong"), c("entities")).alias("exact_match_rate"),
    )


def _steps(scored: DataFrame) -> DataFrame:
    """``curve`` and, for each score, its own positives and negatives (pos, neg).

    Scores are first counted, then dealt to cells at approximate quantiles of the distinct ones. A window runs within
    each cell; what stands above a cell comes from the cells' totals, at most ``CELLS`` rows. Null scores come last; a null label is a negative.
    """
    label = F.coalesce("label", F.lit(0))
    counts = keep(scored.groupBy("score").agg(F.sum(label).alias("pos"), F.count_if(label == 0).alias("neg")), "scores")
    score = F.col("score").cast("double")
    cuts = counts.agg(F.percentile_approx(score, [i / CELLS for i in range(1, CELLS)], 4 * CELLS)).first()[0] or []
    dealt = counts.withColumn("cell", F.size(F.filter(F.array(*map(F.lit, sorted(set(cuts)))).cast("array<double>"), lambda x: x < score)))
    above = Window.orderBy(F.desc("cell")).rowsBetween(Window.unboundedPreceding, -1)
    totals = dealt.groupBy("cell").agg(F.sum("pos").alias("cell_pos"), F.sum("neg").alias("cell_neg"))
    before = lambda c: F.coalesce(F.sum(c).over(above), F.lit(0))
    heads = totals.select("cell", before("cell_pos").alias("tp_above"), before("cell_neg").alias("fp_above"), F.sum("cell_pos").over(Window.partitionBy()).alias("positives"))
    down = Window.partitionBy("cell").orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, 0)
    placed = dealt.join(F.broadcast(heads), "cell")
    return placed.select("score", "pos", "neg", (F.sum("pos").over(down) + F.col("tp_above")).alias("tp"), (F.sum("neg").over(down) + F.col("fp_above")).alias("fp"), "positives")


def curve(scored: DataFrame) -> DataFrame:
    """score, tp, fp, positives: cumulated from the highest score down, one row for each distinct score."""
    return _steps(scored).select("score", "tp", "fp", "positives")


def best_f1(scored: DataFrame) -> DataFrame:
    """One row: the threshold of largest F1, and precision, recall and F1 there; ties go to the higher threshold. Without a positive, no row."""
    p, r = F.col("tp") / (F.col("tp") + F.col("fp")), F.col("tp") / F.col("positives")
    points = curve(scored).filter("tp > 0").select("score", p.alias("precision"), r.alias("recall"), (2 * F.col("tp") / (F.col("tp") + F.col("fp") + F.col("positives"))).alias("f1"))
    best = F.max(F.struct("f1", "score", "precision", "recall"))
    return points.agg(best.alias("b")).filter("b IS NOT NULL").select(F.col("b.score").alias("threshold"), F.col("b.precision").alias("precision"), F.col("b.recall").alias("recall"), F.col("b.f1").alias("f1"))


def average_precision(scored: DataFrame) -> DataFrame:
    """One row: average precision, and ROC area by the trapezium rule; 0 where a class is missing."""
    c = _steps(scored)
    ap = F.sum(F.when(F.col("positives") > 0, F.col("pos") / F.col("positives") * F.col("tp") / (F.col("tp") + F.col("fp"))))
    size = F.max("positives") * F.max("fp")
    area = F.when(size > 0, F.sum(F.col("neg") * (2 * F.col("tp") - F.col("pos")) / 2.0) / size)
    return c.agg(F.coalesce(ap, F.lit(0.0)).alias("average_precision"), F.coalesce(area, F.lit(0.0)).alias("roc_auc"))


def at_thresholds(scored: DataFrame, thresholds: list[float]) -> DataFrame:
    """threshold, precision, recall, f1."""
    one = scored.agg(F.sum("label").alias("pos"), *[F.count_if((F.col("score") >= t) & (F.col("label") == v)).alias(f"{name}{i}") for i, t in enumerate(thresholds) for name, v in (("tp", 1), ("fp", 0))])
    tp, fp, pos = F.col("tp"), F.col("fp"), F.col("pos")
    rows = one.select("pos", F.inline(F.array(*[F.struct(F.lit(t).alias("threshold"), F.col(f"tp{i}").alias("tp"), F.col(f"fp{i}").alias("fp")) for i, t in enumerate(thresholds)])))
    rate = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    return rows.select("threshold", rate(tp, tp + fp).alias("precision"), rate(tp, pos).alias("recall"), rate(2 * tp, tp + fp + pos).alias("f1"))


def profile_source(records: DataFrame, columns: list[str], key: str) -> DataFrame:
    """One row: rows, columns, distinct and duplicate keys, and empty values by column."""
    empty = lambda c: F.count_if(F.coalesce(F.col(c).cast("string"), F.lit("")) == "")
    return records.agg(F.count("*").alias("n_rows"), F.lit(len(columns)).alias("n_columns"), F.countDistinct(key).alias("n_keys"), (F.count(key) - F.countDistinct(key)).alias("n_duplicates"), *[empty(c).alias(f"empty_{c}") for c in columns])


def frequency(records: DataFrame, column: str) -> DataFrame:
    """value, n, percent; the total is a one-row side."""
    counts = records.groupBy(F.col(column).alias("value")).agg(F.count("*").alias("n"))
    return counts.join(F.broadcast(counts.agg(F.sum("n").alias("total")))).select("value", "n", (100.0 * F.col("n") / F.col("total")).alias("percent"))


def profile_truth(lists: DataFrame) -> DataFrame:
    """One row over (s1, ids array): singletons, one and several matches, most, mean, and S2 and S3 counts and distinct."""
    n = F.size("ids")
    part = lambda s: F.size(F.filter("ids", lambda x: F.startswith(x, F.lit(s))))
    sizes = lists.agg(F.count("*").alias("entities"), F.count_if(n == 0).alias("singletons"), F.count_if(n == 1).alias("single"), F.count_if(n > 1).alias("several"), F.max(n).alias("most"), F.avg(n).alias("mean"), F.sum(part("S2-")).alias("s2"), F.sum(part("S3-")).alias("s3"))
    ids = lists.select(F.explode("ids").alias("id")).agg(F.countDistinct(F.when(F.startswith("id", F.lit("S2-")), F.col("id"))).alias("s2_distinct"), F.countDistinct(F.when(F.startswith("id", F.lit("S3-")), F.col("id"))).alias("s3_distinct"))
    return sizes.join(F.broadcast(ids))
