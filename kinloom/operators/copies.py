"""Classes of records of equal content: what depends on the content is found once a pair of classes, then dealt to the members."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kinloom.operators import blocking as B
from kinloom.store import keep, large

_CONTENT = ("business_name", "business_address", "country")


def classes(records: DataFrame, *more: str) -> tuple[DataFrame, DataFrame]:
    """(the classes, their members) by name, address, country and the columns ``more``, apart for S1 and the other sources.

    Classes look like records (of S1 or S2) with their number as ``entity_id``; of their members n1 are S1 and n2 others. Members: cls, entity_id, source, ord.
    """
    columns = (*_CONTENT, *more)
    one = F.col("source") == "S1"
    rows = records.withColumn("content", F.to_json(F.struct(*columns, one.alias("__one"))))
    found = rows.groupBy("content").agg(*[F.first(c).alias(c) for c in columns], F.count_if(one).alias("n1"), F.count_if(~one).alias("n2"))
    found = keep(found.select("*", F.monotonically_increasing_id().cast("string").alias("entity_id"), F.when(F.col("n1") > 0, "S1").otherwise("S2").alias("source"), F.lit(0).alias("ord")), "classes")
    return found.drop("content"), rows.join(large(found.select("content", F.col("entity_id").alias("cls"))), "content").select("cls", "entity_id", "source", "ord")


def candidates(found: DataFrame, generator: str = "serve", most: int = 60) -> DataFrame:
    """``blocking.candidates`` of classes (made with ``truth_key``): s1, target, n_blocks, blocks, label, n1, n2, for n1 S1 records of one class and n2 others of the other."""
    k = keep(B.keys(found, generator).select("entity_id", "block", "key").join(large(found.select("entity_id", "n1", "n2", "truth_key")), "entity_id"), "class-keys")
    light = k.filter("n1 > 0").groupBy("key").agg(F.sum("n1").alias("n"), F.sum("n2").alias("m")).filter(F.col("n") <= most).select("key")
    one = k.filter("n1 > 0").join(large(light), "key", "left_semi").select("key", "block", F.col("entity_id").alias("s1"), "n1", F.col("truth_key").alias("t1"))
    two = k.filter("n2 > 0").select("key", F.col("entity_id").alias("target"), "n2", F.col("truth_key").alias("t2"))
    hits = one.join(large(two), "key").select("s1", "target", "block", "n1", "n2", F.coalesce((F.col("t1") == F.col("t2")).cast("int"), F.lit(0)).alias("label"))
    return hits.groupBy("s1", "target", "n1", "n2", "label").agg(F.count("*").alias("n_blocks"), F.array_join(F.array_sort(F.collect_set("block")), ",").alias("blocks"))


def each(found: DataFrame, of: DataFrame) -> DataFrame:
    """The rows of S1 classes (``canonical_id``) once for each of their members."""
    one = of.filter("source = 'S1'").select(F.col("cls").alias("canonical_id"), "entity_id")
    return one.join(large(found), "canonical_id").drop("canonical_id").withColumnRenamed("entity_id", "canonical_id")


def members(pairs: DataFrame, of: DataFrame, *columns: str) -> DataFrame:
    """s1, target, target_source, target_ord and ``columns``: the records' pairs of the classes' pairs."""
    one = of.filter("source = 'S1'").select(F.col("cls").alias("s1"), F.col("entity_id").alias("__one"))
    two = of.filter("source <> 'S1'").select(F.col("cls").alias("target"), F.col("entity_id").alias("__two"), F.col("source").alias("target_source"), F.col("ord").alias("target_ord"))
    both = pairs.select("s1", "target", *columns).join(large(one), "s1").join(large(two), "target")
    return both.select(F.col("__one").alias("s1"), F.col("__two").alias("target"), "target_source", "target_ord", *columns)


def first_targets(pairs: DataFrame, of: DataFrame, most: int) -> DataFrame:
    """s1, target, target_source, target_ord, rank: of each S1 record the first ``most`` targets in source order, of all classes that its own is paired with.

    A class can only give one of them if its first member is among the first of so many classes.
    """
    two = of.filter("source <> 'S1'").select(F.col("cls").alias("to"), F.col("entity_id").alias("target"), F.col("source").alias("target_source"), F.col("ord").alias("target_ord"))
    each = Window.partitionBy("to").orderBy("target_source", "target_ord")
    two = keep(two.withColumn("place", F.row_number().over(each)).filter(F.col("place") <= most), "first-members")
    heads = two.filter("place = 1").select("to", "target_source", "target_ord")
    order = Window.partitionBy("from").orderBy("target_source", "target_ord")
    near = pairs.select(F.col("s1").alias("from"), F.col("target").alias("to")).join(heads, "to").withColumn("place", F.row_number().over(order)).filter(F.col("place") <= most).select("from", "to")
    best = near.join(two.drop("place"), "to").withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= most)
    one = of.filter("source = 'S1'").select(F.col("cls").alias("from"), F.col("entity_id").alias("s1"))
    return one.join(best, "from").select("s1", "target", "target_source", "target_ord", "rank")
