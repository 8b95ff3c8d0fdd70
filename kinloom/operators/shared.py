"""Counts of the pairs that share a key, without the pairs.

Pairs grow with the square of a posting list, their counts needn't be found that way. Records of equal content have
equal keys, so keys are made once a content; entities of equal contents and truth are one class. The number of a class's
partners that share any of its keys is, by inclusion and exclusion, a signed sum of the numbers of those that
have all keys of a subset, and those are plain sums by subset. All of it is exact.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinloom.operators import blocking as B
from kinloom.store import keep

#: The block of the keys that true pairs share.
TRUTH = "="
#: Classes of more keys than this (entities of several different records) meet their partners one by one.
WIDE = 12

_CONTENT = ("business_name", "business_address", "country")


def posted(records: DataFrame, generator: str = "serve", most: int | None = None) -> DataFrame:
    """cls, n1, n2, block, key (a number): the keys of each class of entities, of which n1 are S1 and n2 others.

    Keys that only one side has are left out, as are those (but for true pairs) that more than ``most`` S1 records have.
    """
    rows = records.filter("source IS NOT NULL").withColumns({"one": F.col("source") == "S1", "content": F.to_json(F.struct(*_CONTENT))})
    contents = rows.groupBy("content").agg(*[F.first(c).alias(c) for c in _CONTENT], F.count_if("one").alias("times"))
    keyed = keep(B.keys(contents.select(F.col("content").alias("entity_id"), F.lit("").alias("source"), F.col("times").alias("ord"), *_CONTENT), generator), "content-keys")
    if most is not None:
        keyed = keyed.join(keyed.groupBy("key").agg(F.sum("ord").alias("times")).filter(F.col("times") <= most).select("key"), "key", "left_semi")
    each = rows.groupBy("entity_id", "one").agg(F.sort_array(F.collect_set("content")).alias("contents"), F.sort_array(F.collect_set("truth_key")).alias("truths"))
    classes = each.groupBy("contents", "truths").agg(F.count_if("one").alias("n1"), F.count_if(~F.col("one")).alias("n2"))
    classes = keep(classes.withColumn("cls", F.monotonically_increasing_id()), "classes")
    shared = classes.select("cls", "n1", "n2", F.explode("contents").alias("entity_id")).join(keyed.select("entity_id", "block", "key"), "entity_id").drop("entity_id")
    true = classes.select("cls", "n1", "n2", F.lit(TRUTH).alias("block"), F.explode("truths").alias("key"))
    found = keep(shared.union(true.select("cls", "n1", "n2", "block", F.concat(F.lit(TRUTH), "key"))).distinct(), "class-keys")
    met = found.groupBy("key").agg(F.sum("n1").alias("a"), F.sum("n2").alias("b")).filter("a > 0 AND b > 0").select("key")
    numbered = keep(met.withColumn("id", F.monotonically_increasing_id()), "numbers")
    return keep(found.join(numbered, "key").select("cls", "n1", "n2", "block", F.col("id").alias("key")), "posted")


def _subsets(keys: str) -> Column:
    return F.aggregate(keys, F.array(F.array().cast("array<bigint>")), lambda all, k: F.concat(all, F.transform(all, lambda s: F.concat(s, F.array(k)))))


def _maximal(each: DataFrame) -> DataFrame:
    """strategy, cls, n1, n2, key without the keys all of whose classes have another key too: that one's pairs include theirs."""
    lists = each.groupBy("strategy", "cls").agg(F.collect_list("key").alias("keys")).groupBy("strategy", F.sort_array("keys").alias("keys")).agg(F.count("*").alias("times"))
    pairs = lists.filter("size(keys) > 1").select("strategy", F.explode("keys").alias("key"), "keys", "times").select("strategy", "key", F.explode("keys").alias("other"), "times").filter("key <> other")
    both = pairs.groupBy("strategy", "key", "other").agg(F.sum("times").alias("both"))
    alone = each.groupBy("strategy", "key").agg(F.count("*").alias("times"))
    held = both.join(alone, ["strategy", "key"]).filter("both = times").join(alone.toDF("strategy", "other", "others"), ["strategy", "other"])
    gone = held.filter("others > times OR other < key").select("strategy", "key").distinct()
    return each.join(gone, ["strategy", "key"], "left_anti")


def counts(post: DataFrame, strategies: dict[str, list[str]]) -> DataFrame:
    """strategy, n, found, times: so many S1 entities share a key of the strategy's blocks with n others, of which found are true.

    ``post`` as from ``posted``. Entities without a partner have no row.
    """
    named = F.array(*[F.struct(F.lit(name).alias("s"), F.array(*map(F.lit, blocks)).alias("b")) for name, blocks in strategies.items()])
    in_ones = F.transform(F.filter(named, lambda x: F.array_contains(x["b"], F.col("block"))), lambda x: x["s"])
    each = keep(_maximal(post.select(F.explode(in_ones).alias("strategy"), "cls", "n1", "n2", "key")), "strategy-keys")
    truths = post.filter(F.col("block") == TRUTH).groupBy("cls").agg(F.sort_array(F.collect_set("key")).alias("t"))
    lists = each.groupBy("strategy", "cls", "n1", "n2").agg(F.sort_array(F.collect_set("key")).alias("k")).join(truths, "cls", "left").withColumn("t", F.coalesce("t", F.array().cast("array<bigint>")))
    groups = lists.groupBy("strategy", "k", "t").agg(F.sum("n1").alias("n1"), F.sum("n2").alias("n2"))
    groups = keep(groups.withColumns({"g": F.monotonically_increasing_id(), "wide": F.size("k") + F.size("t") > WIDE}), "groups")
    light = groups.filter("NOT wide")
    every = light.select("strategy", "g", "n1", "n2", "k", F.explode(_subsets("t")).alias("t")).select("strategy", "g", "n1", "n2", "t", F.explode(_subsets("k")).alias("k")).filter("size(k) > 0")
    sums = every.groupBy("strategy", "t", "k").agg(F.sum("n1").alias("one"), F.sum("n2").alias("two")).filter("one > 0 AND two > 0").drop("one")
    # One key more turns the sign, of the truth's keys as of the others.
    sign = F.when((F.size("k") + F.size("t")) % 2 == 1, 1).otherwise(-1)
    met = every.filter("n1 > 0").join(sums, ["strategy", "t", "k"]).groupBy("strategy", "g", "n1").agg(
        F.sum(F.when(F.size("t") == 0, sign * F.col("two")).otherwise(0)).alias("n"), F.sum(F.when(F.size("t") > 0, -sign * F.col("two")).otherwise(0)).alias("found")
    )
    if not groups.filter("wide").isEmpty():
        met = met.unionByName(_met(groups.filter("wide"), groups)).unionByName(_met(light, groups.filter("wide")))
        met = met.groupBy("strategy", "g", "n1").agg(F.sum("n").alias("n"), F.sum("found").alias("found"))
    return met.filter("n > 0").groupBy("strategy", "n", "found").agg(F.sum("n1").alias("times"))


def _met(ones: DataFrame, others: DataFrame) -> DataFrame:
    """strategy, g, n1, n, found by the pairs of groups."""
    a = ones.filter("n1 > 0").select("strategy", "g", "n1", F.col("t").alias("t1"), F.explode("k").alias("key"))
    b = others.filter("n2 > 0").select("strategy", F.col("g").alias("other"), "n2", F.col("t").alias("t2"), F.explode("k").alias("key"))
    pairs = a.join(b, ["strategy", "key"]).dropDuplicates(["strategy", "g", "other"])
    return pairs.groupBy("strategy", "g", "n1").agg(F.sum("n2").alias("n"), F.sum(F.when(F.arrays_overlap("t1", "t2"), F.col("n2")).otherwise(0)).alias("found"))
