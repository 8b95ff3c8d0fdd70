"""Review queue, decisions and audit log over an append-only table of actions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DECISIONS = ("CONFIRMED", "SEPARATED", "MERGED", "REJECTED")


def decision(x) -> Column:
    """Upper-cased; what isn't a decision counts as CONFIRMED."""
    up = F.upper(F.col(x) if isinstance(x, str) else x)
    return F.when(up.isin(*DECISIONS), up).otherwise("CONFIRMED")


def submit(log: DataFrame, actions: DataFrame) -> DataFrame:
    """``log`` with the rows of ``actions`` (canonical_id, decision, reviewer, reason, ts) appended."""
    note = F.when(F.coalesce("reason", F.lit("")) == "", F.concat(F.lit("Manual adjudication: marked as "), decision("decision"))).otherwise(F.col("reason"))
    return log.unionByName(actions.select("canonical_id", decision("decision").alias("decision"), F.coalesce("reviewer", F.lit("Admin Reviewer")).alias("reviewer"), note.alias("reason"), "ts"))


def latest(actions: DataFrame, key: str, ts: str, seq: str) -> DataFrame:
    """The last action of each key, by time and then sequence."""
    w = Window.partitionBy(key).orderBy(F.desc(ts), F.desc(seq))
    return actions.withColumn("rank", F.row_number().over(w)).filter("rank = 1").drop("rank")


def audit_log(actions: DataFrame, ts: str, seq: str, limit: int = 20) -> DataFrame:
    """The newest ``limit`` actions."""
    return actions.orderBy(F.desc(ts), F.desc(seq)).limit(limit)


def queue(lists: DataFrame, decided: DataFrame, limit: int) -> DataFrame:
    """Entities whose match list is longer than ten characters, with their last decision, or a status from their id.

    ``lists`` (entity_id, matched), ``decided`` (entity_id, decision).
    """
    total = F.aggregate(F.split("entity_id", ""), F.lit(0), lambda n, c: n + F.when(c == "", 0).otherwise(F.ascii(c)))
    flagged = total % 3 == 0
    full = lists.filter(F.length("matched") > 10).join(decided, "entity_id", "left")
    status = F.coalesce("decision", F.when(flagged, "NEEDS_REVIEW").otherwise("AUTO_MATCHED"))
    return full.select("entity_id", (F.size(F.split("matched", ",")) + 1).alias("n_sources"), flagged.alias("conflict"), status.alias("status")).orderBy("entity_id").limit(limit)
