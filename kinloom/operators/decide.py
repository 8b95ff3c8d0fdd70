"""Decisions on scored pairs, and lists of matches per record."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Thresholds by name.
FLAT, HIGH, LOW, MIDDLE = 0.4365, 0.75, 0.58, 0.65


def settled(scored: DataFrame, *columns: str) -> DataFrame:
    """``scored`` with ``columns`` as the output of a one-row generator.

    A filter on them stays above it; pushed below, it would evaluate each similarity once more for every use.
    """
    rest = [F.col(c) for c in scored.columns if c not in columns]
    return scored.select(*rest, F.inline(F.array(F.struct(*columns))))


def flat(scored: DataFrame, threshold: float = FLAT) -> DataFrame:
    return settled(scored, "score").filter(F.col("score") >= threshold)


def margin(scored: DataFrame) -> DataFrame:
    """Where an s1's best score is 0.85 or more, all within 0.25 of it (0.60 at least); else 0.60 or more."""
    best = F.max("score").over(Window.partitionBy("s1"))
    limit = F.when(F.col("best") >= 0.85, F.greatest(F.lit(0.60), F.col("best") - 0.25)).otherwise(0.60)
    return scored.withColumn("best", best).filter(F.col("score") >= limit).drop("best")


def agreement_tested(scored: DataFrame) -> DataFrame:
    """High scores, and middling ones with an exact name, two strong similarities or an equal house number."""
    agree = (F.col("name_exact_match") == 1) | (F.col("both_strong") == 1) | (F.col("addr_house_number_match") == 1)
    return settled(scored, "score", "name_exact_match", "both_strong", "addr_house_number_match").filter((F.col("score") >= HIGH) | ((F.col("score") >= LOW) & agree))


def agreement_shipped(scored: DataFrame) -> DataFrame:
    """As ``agreement_tested``, but two given addresses suffice from 0.65 on, in place of strong similarities."""
    given = (F.col("s1_addr_missing") == 0) & (F.col("cand_addr_missing") == 0)
    agree = (F.col("name_exact_match") == 1) | ((F.col("score") >= MIDDLE) & given) | (F.col("addr_house_number_match") == 1)
    return settled(scored, "score", "name_exact_match", "s1_addr_missing", "cand_addr_missing", "addr_house_number_match").filter((F.col("score") >= HIGH) | ((F.col("score") >= LOW) & agree))


def agreement_documented(scored: DataFrame) -> DataFrame:
    """The same with 0.65 alone as agreement."""
    agree = (F.col("name_exact_match") == 1) | (F.col("score") >= MIDDLE) | (F.col("addr_house_number_match") == 1)
    return settled(scored, "score", "name_exact_match", "addr_house_number_match").filter((F.col("score") >= HIGH) | ((F.col("score") >= LOW) & agree))


RULES = {"flat": flat, "margin": margin, "tested": agreement_tested, "shipped": agreement_shipped, "documented": agreement_documented}


def match_lists(records: DataFrame, matches: DataFrame, order: str = "target_ord") -> DataFrame:
    """entity_id, matched: one row for every S1 record, its targets joined by commas, empty without any."""
    lists = matches.groupBy("s1").agg(F.array_join(F.transform(F.array_sort(F.collect_set(F.struct(order, "target"))), lambda x: x["target"]), ",").alias("matched"))
    one = records.filter("source = 'S1'").select("entity_id")
    return one.join(lists.withColumnRenamed("s1", "entity_id"), "entity_id", "left").select("entity_id", F.coalesce("matched", F.lit("")).alias("matched"))


def by_probability(matches: DataFrame) -> DataFrame:
    """s1, matched: targets by falling score, then id, each once."""
    ranked = F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("neg"), "target")))
    return matches.groupBy("s1").agg(F.array_join(F.array_distinct(F.transform(ranked, lambda x: x["target"])), ",").alias("matched"))
