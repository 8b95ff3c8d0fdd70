"""The service's operations as methods, one for each route; each returns a DataFrame.

A ``Service`` stands on three tables: records (entity_id, source, ord, business_name, business_address, country), matches
(s1, target) and review actions (canonical_id, decision, reviewer, reason, ts). Nothing is read before a result is.
An id that no entity has gives no rows; an empty query or batch is an error, as is a limit out of range.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinloom.functions import text as X
from kinloom.operators import decide, explain, review, search

ACTIONS = "canonical_id string, decision string, reviewer string, reason string, ts timestamp"
TEXT = ["entity_id", "business_name", "business_address", "country"]
#: Operation -> route.
ROUTES = {
    "root": "GET /",
    "health": "GET /api/health",
    "search": "GET /api/search",
    "entity": "GET /api/entity/{id}",
    "graph": "GET /api/graph/{id}",
    "passport": "GET /api/passport/{id}",
    "review_queue": "GET /api/review-queue",
    "review_action": "POST /api/review-action",
    "audit_logs": "GET /api/audit-logs",
    "batch_resolve": "POST /api/batch-resolve",
    "batch_sample": "GET /api/batch-sample",
    "demo_queries": "GET /api/demo-queries",
    "stats": "GET /api/stats",
}


def _within(limit: int, most: int) -> int:
    if not 1 <= limit <= most:
        raise ValueError(f"limit must be from 1 to {most}")
    return limit


class Service:
    def __init__(self, records: DataFrame, matches: DataFrame, actions: DataFrame | None = None) -> None:
        self.spark = records.sparkSession
        self.records, self.matches = records, matches
        self.actions = self.spark.createDataFrame([], ACTIONS) if actions is None else actions
        self.entities = records.filter("source = 'S1'")

    @cached_property
    def sources(self) -> DataFrame:
        return explain.linked(self.entities, self.matches, self.records)

    def _sources_of(self, canonical_id: str) -> DataFrame:
        """The sources of one entity: the filters reach the scans, before any join."""
        one = self.entities.filter(F.col("entity_id") == canonical_id)
        return explain.linked(one, self.matches.filter(F.col("s1") == canonical_id), self.records)

    def root(self) -> DataFrame:
        """operation, route."""
        return self.spark.createDataFrame(list(ROUTES.items()), "operation string, route string")

    def health(self) -> DataFrame:
        """status, entities, links: one row."""
        return self.entities.agg(F.lit("healthy").alias("status"), F.count("*").alias("entities")).join(self.matches.agg(F.count("*").alias("links")))

    def search(self, q: str, country: str | None = None, limit: int = 10) -> DataFrame:
        """The parsed query's ``limit`` best entities, or the one that it names by id: query, doc, score, confidence, rank."""
        if not q or not q.strip():
            raise ValueError("the query is empty")
        _within(limit, 50)
        among = self.entities
        if country and country.lower() != "all":
            among = among.filter(F.upper(F.trim("country")) == country.strip().upper())
        asked = self.spark.createDataFrame([(q, q)], "query string, text string")
        copies = explain.linked(among, self.matches, self.records).withColumns({"raw_name": F.col("name"), "raw_address": F.col("address")})
        return search.ask(asked, "query", "text", among, search.index(among, "entity_id", TEXT), explain.evidence(copies), limit)

    def entity(self, canonical_id: str) -> DataFrame:
        """The entity with its evidence, conflict, aliases and category: one row."""
        of = self._sources_of(canonical_id)
        ev = explain.evidence(of)
        head = of.filter("idx = 0").select("canonical_id", "name", "address", "country", X.category("name", "address").alias("category"))
        return head.join(ev, "canonical_id").join(explain.conflicts(ev), "canonical_id").join(explain.aliases(of), "canonical_id")

    def graph(self, canonical_id: str) -> DataFrame:
        """kind, id, target, label: the nodes, and the edges with their relation as label."""
        of = self._sources_of(canonical_id)
        nodes = explain.graph_nodes(of).select(F.lit("node").alias("kind"), F.col("node_id").alias("id"), F.lit(None).cast("string").alias("target"), "label")
        edges = explain.graph_edges(of, explain.conflicts(explain.evidence(of)))
        return nodes.unionByName(edges.select(F.lit("edge").alias("kind"), F.col("source").alias("id"), "target", F.col("relation").alias("label")))

    def passport(self, canonical_id: str) -> DataFrame:
        of = self._sources_of(canonical_id)
        ev = explain.evidence(of)
        return explain.passports(of, ev, explain.conflicts(ev))

    def review_queue(self, limit: int = 15) -> DataFrame:
        decided = review.latest(self.actions, "canonical_id", "ts", "decision").select(F.col("canonical_id").alias("entity_id"), "decision")
        by_id = self.matches.select("s1", "target", F.lit(0).alias("target_ord"))
        return review.queue(decide.match_lists(self.records, by_id), decided, _within(limit, 50))

    def review_action(self, canonical_id: str, decision: str, reviewer: str | None = None, reason: str = "") -> DataFrame:
        """Appends a decision to the log that later calls see, and returns its row."""
        row = self.spark.createDataFrame([(canonical_id, decision, reviewer, reason)], "canonical_id string, decision string, reviewer string, reason string")
        # A literal time, so that the log doesn't change between two readings.
        now = self.spark.sql("SELECT current_timestamp()").first()[0]
        added = review.submit(self.spark.createDataFrame([], ACTIONS), row.withColumn("ts", F.lit(now)))
        self.actions = self.actions.unionByName(added)
        return added

    def audit_logs(self, limit: int = 20) -> DataFrame:
        return review.audit_log(self.actions, "ts", "canonical_id", _within(limit, 100))

    def batch_resolve(self, batch: DataFrame) -> DataFrame:
        """``batch`` (id, name, address) resolved; ``search.batch_summary`` counts the result by status."""
        return search.resolve(batch, self.entities, search.index(self.entities, "entity_id", TEXT))

    def batch_sample(self, limit: int = 5) -> DataFrame:
        """Records of the other sources as a batch to try."""
        others = self.records.filter("source <> 'S1'").orderBy("entity_id").limit(_within(limit, 50))
        return others.select(F.col("entity_id").alias("id"), F.col("business_name").alias("name"), F.col("business_address").alias("address"), "country")

    def demo_queries(self, limit: int = 5) -> DataFrame:
        """Names of entities as queries to try, with what parsing them gives."""
        return search.parse_query(self.entities.orderBy("entity_id").limit(_within(limit, 50)).select(F.col("business_name").alias("text")))

    def stats(self) -> DataFrame:
        """figure, value, n: totals, entities by country, and the five most common categories."""
        count = lambda df, figure, by: df.groupBy(by.alias("value")).agg(F.count("*").alias("n")).select(F.lit(figure).alias("figure"), "value", "n")
        top = count(self.entities, "category", X.category("business_name", "business_address")).orderBy(F.desc("n"), "value").limit(5)
        return count(self.records, "source", F.col("source")).unionByName(count(self.entities, "country", F.col("country"))).unionByName(top)
