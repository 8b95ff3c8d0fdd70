"""Checks of a submission: one row for each rule with its severity and the number of offenders."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinloom.functions.tokens import parse_ids
from kinloom.store import keep


def header(line: str, expected: tuple[str, str]) -> list[str]:
    """Faults of a header line."""
    if "\t" not in line:
        return ["header isn't tab separated"]
    return [] if tuple(line.rstrip("\r\n").split("\t")) == expected else ["wrong header"]


def submission(lists: DataFrame, s1: DataFrame, known: DataFrame | None = None, candidates: DataFrame | None = None) -> DataFrame:
    """rule, severity, n over ``lists`` (s1, ids), ``s1`` (s1), ``known`` (target) and candidate lists (s1, ids).

    Errors but for matches outside the candidates, and a missing candidate file, which are warnings.
    """
    rows = keep(lists.select("s1", parse_ids("ids").alias("ids")), "lists")
    each = rows.select("s1", F.explode("ids").alias("target"))
    count = lambda name, severity, df: df.agg(F.count("*").alias("n")).select(F.lit(name).alias("rule"), F.lit(severity).alias("severity"), "n")
    # Rules of a single row are counted together.
    such = lambda test: F.coalesce(F.sum(F.size(F.filter("ids", test))), F.lit(0)).cast("long")
    own = {
        "repeated ids in a list": F.count_if(F.size(F.array_distinct("ids")) < F.size("ids")),
        "S1 ids in lists": such(lambda x: F.startswith(x, F.lit("S1-"))),
        "bad id prefix": such(lambda x: ~x.rlike("^S[123]-")),
    }
    found = [
        count("duplicate S1 rows", "error", rows.groupBy("s1").count().filter("count > 1")),
        rows.agg(F.array(*[F.struct(F.lit(name).alias("rule"), F.lit("error").alias("severity"), n.alias("n")) for name, n in own.items()]).alias("all")).select(F.inline("all")),
        count("missing S1", "error", s1.select("s1").distinct().join(rows.select("s1").distinct(), "s1", "left_anti")),
        count("foreign S1", "error", rows.select("s1").distinct().join(s1.select("s1"), "s1", "left_anti")),
    ]
    if known is not None:
        found.append(count("unknown ids", "error", each.select("target").distinct().join(known, "target", "left_anti")))
    if candidates is None:
        found.append(s1.agg(F.lit(1).cast("long").alias("n")).select(F.lit("no candidate file").alias("rule"), F.lit("warning").alias("severity"), "n"))
    else:
        allowed = candidates.select("s1", F.explode(parse_ids("ids")).alias("target"))
        found.append(count("matches outside candidates", "warning", each.distinct().join(allowed, ["s1", "target"], "left_anti")))
    return reduce(DataFrame.unionByName, found)


def assertions(labelled: DataFrame, columns: list[str]) -> DataFrame:
    """rule, n: labels other than 0 and 1, and nulls or NaN in any of ``columns``."""
    bad = lambda c: F.count_if(F.col(c).isNull() | F.isnan(F.col(c).cast("double")))
    one = labelled.agg(F.count_if(~F.col("label").isin(0, 1)).alias("label"), *[bad(c).alias(c) for c in columns])
    return one.select(F.inline(F.array(*[F.struct(F.lit(c).alias("rule"), F.col(c).alias("n")) for c in ("label", *columns)])))
