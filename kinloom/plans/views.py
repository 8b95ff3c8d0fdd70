"""The record tables that queries run over, derived from the test tables.

The expressions below are read by both engines, so each side of a comparison starts from equal rows.
Records of three sources come from ``part``: partkey modulo 3 is the source, the brand its country, and
names and addresses are written in the ways that sources differ in. Records of equal brand, name and
type are one entity.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

_NAME = """CASE p_partkey % 7
 WHEN 1 THEN concat(upper(p_name), ' LLC')
 WHEN 2 THEN concat('M/s ', p_name, ' Pvt. Ltd')
 WHEN 3 THEN concat(replace(p_name, ' ', ''), '.com')
 WHEN 4 THEN concat('www.', replace(p_name, ' ', ''), '.in/shop')
 WHEN 5 THEN concat('The Old Co, formerly ', p_name)
 WHEN 6 THEN replace(p_name, 'o', '0')
 ELSE p_name END"""
_ADDRESS = """CASE p_partkey % 5
 WHEN 1 THEN concat('Plot No. ', lpad(cast(p_size AS string), 4, '0'), ', ', p_type, ' St, Mumbai 40', lpad(cast(p_size AS string), 4, '0'))
 WHEN 2 THEN concat(cast(p_size AS string), '/0', cast(p_size % 9 AS string), ' ', p_type, ' Rd near City Mall, Paris, FR')
 WHEN 3 THEN concat('Flat 12, ', cast(p_size AS string), '-4 rue de ', p_type, ', Lyon 7500', cast(p_size % 10 AS string))
 WHEN 4 THEN ''
 ELSE concat(cast(p_size AS string), ' ', p_type) END"""

RECORD = {
    "entity_id": "concat('S', cast(p_partkey % 3 + 1 AS string), '-', cast(p_partkey AS string))",
    "source": "concat('S', cast(p_partkey % 3 + 1 AS string))",
    "ord": "p_partkey",
    "business_name": _NAME,
    "business_address": _ADDRESS,
    "country": "p_brand",
    "truth_key": "concat(p_brand, '|', p_name, '|', p_type)",
}
PLAIN = RECORD | {"business_name": "p_name", "business_address": "concat(cast(p_size AS string), ' ', p_type)"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def records(spark: SparkSession, sf_dir: str, messy: bool = True) -> DataFrame:
    """entity_id, source, ord, business_name, business_address, country, truth_key."""
    return table(spark, sf_dir, "part").selectExpr(*[f"{sql} AS {name}" for name, sql in (RECORD if messy else PLAIN).items()])


def records_sql(messy: bool = True) -> str:
    return "SELECT " + ", ".join(f"{sql} AS {name}" for name, sql in (RECORD if messy else PLAIN).items()) + " FROM part"


def truth_pairs(recs: DataFrame) -> DataFrame:
    """(s1, target) of the records of one entity across the sources."""
    from pyspark.sql import functions as F

    one = recs.filter("source = 'S1'").select(F.col("entity_id").alias("s1"), "truth_key")
    two = recs.filter("source <> 'S1'").select(F.col("entity_id").alias("target"), "truth_key")
    return one.join(two, "truth_key").select("s1", "target")


TRUTH_SQL = "SELECT x.entity_id AS s1, y.entity_id AS target FROM rec x JOIN rec y ON x.truth_key = y.truth_key AND x.source = 'S1' AND y.source <> 'S1'"
