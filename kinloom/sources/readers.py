"""Readers. A missing text is an empty string everywhere, never null."""

from __future__ import annotations

import json
import os

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

RECORD_COLUMNS = ("entity_id", "business_name", "business_address", "country")
PLACES_OF_DATA = ("dataset", "../dataset", "../../dataset", "data", "../data")
THRESHOLDS = {"optimal_threshold": 0.4365, "high_threshold": 0.75, "low_threshold": 0.58}


def tsv(spark: SparkSession, path: str, columns: tuple[str, ...] = RECORD_COLUMNS) -> DataFrame:
    """A tab separated file with a header, all text; the schema is given, so there is no inference pass."""
    schema = ", ".join(f"`{c}` string" for c in columns)
    return spark.read.csv(path, sep="\t", header=True, schema=schema, quote="", emptyValue="", nullValue=None).na.fill("")


def records(spark: SparkSession, path: str) -> DataFrame:
    """Source records with their source, from the id's prefix, and a place in the file."""
    df = tsv(spark, path)
    return df.select("*", F.substring("entity_id", 1, 2).alias("source"), F.monotonically_increasing_id().alias("ord"))


def head(df: DataFrame, n: int, order: str) -> DataFrame:
    """The first n rows by an explicit order; a file's own order isn't one."""
    return df.orderBy(order).limit(n)


def only(df: DataFrame, key: str, wanted: DataFrame) -> DataFrame:
    """Rows whose key is wanted (a semi-join)."""
    return df.join(wanted.select(key).distinct(), key, "left_semi")


def by_country(df: DataFrame, other: DataFrame) -> DataFrame:
    """Rows of countries that ``other`` has."""
    return df.join(other.select("country").distinct(), "country", "left_semi")


def linked_sources(lists: DataFrame, sources: DataFrame) -> DataFrame:
    """The source records that match lists name: s1 and the record."""
    from kinloom.functions.tokens import parse_ids

    ids = lists.select("s1", F.explode(parse_ids("ids")).alias("entity_id"))
    return ids.join(sources, "entity_id")


def first_column(spark: SparkSession, path: str) -> DataFrame:
    """Ids of the first column of a text file: the header and blank lines skipped, trimmed."""
    lines = spark.read.text(path).select(F.trim(F.split("value", "\t")[0]).alias("id"), F.monotonically_increasing_id().alias("n"))
    first = lines.agg(F.min("n").alias("n0"))
    return lines.join(F.broadcast(first)).filter((F.col("n") > F.col("n0")) & (F.col("id") != "")).select("id")


def parquet(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def data_dir(places: tuple[str, ...] = PLACES_OF_DATA, base: str = ".") -> str:
    """The first of the places that has a ``train`` folder."""
    for place in places:
        if os.path.isdir(os.path.join(base, place, "train")):
            return os.path.normpath(os.path.join(base, place))
    raise FileNotFoundError(f"no folder with train/ among {', '.join(places)}")


def thresholds(path: str | None = None) -> dict[str, float]:
    """Thresholds of a JSON file over the defaults."""
    if path and os.path.exists(path):
        with open(path, encoding="utf-8") as f:
            return THRESHOLDS | json.load(f)
    return dict(THRESHOLDS)


def batch_input(inputs: DataFrame, column: str = "body") -> DataFrame:
    """Ad-hoc records from a JSON array or else CSV lines ``name,address,country``.

    id, name, address, country; ids are ROW-101 and on, a missing country is India.
    """
    item = "array<struct<id string, name string, raw_name string, address string, raw_address string, country string>>"
    is_json = F.trim(column).rlike(r"^\[")
    parsed = F.from_json(F.when(is_json, F.col(column)), item)
    line = lambda x: F.transform(F.split(x, ","), lambda p: F.trim(p))
    part = lambda x, i: F.coalesce(F.try_element_at(line(x), F.lit(i)), F.lit(""))
    rows = F.transform(F.filter(F.split(column, r"\n"), lambda x: F.trim(x) != ""), lambda x: F.struct(F.lit(None).cast("string").alias("id"), part(x, 1).alias("name"), F.lit(None).cast("string").alias("raw_name"), part(x, 2).alias("address"), F.lit(None).cast("string").alias("raw_address"), F.when(part(x, 3) == "", "India").otherwise(part(x, 3)).alias("country")))
    each = inputs.select(F.posexplode(F.when(is_json, parsed).otherwise(rows)).alias("pos", "r"))
    return each.select(F.coalesce("r.id", F.concat(F.lit("ROW-"), (F.col("pos") + 101).cast("string"))).alias("id"), F.coalesce("r.name", "r.raw_name", F.lit("")).alias("name"), F.coalesce("r.address", "r.raw_address", F.lit("")).alias("address"), F.coalesce("r.country", F.lit("India")).alias("country"))


def keep_first(df: DataFrame, key: str, order: str) -> DataFrame:
    """Insert-or-ignore: the first row of each key."""
    return _one(df, key, F.asc(order))


def keep_last(df: DataFrame, key: str, order: str) -> DataFrame:
    """Insert-or-replace: the last row of each key."""
    return _one(df, key, F.desc(order))


def _one(df: DataFrame, key: str, order) -> DataFrame:
    w = Window.partitionBy(key).orderBy(order)
    return df.withColumn("__rank", F.row_number().over(w)).filter("__rank = 1").drop("__rank")
