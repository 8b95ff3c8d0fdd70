"""Explanations of a resolved entity: evidence, conflicts, timeline, passport, aliases, its graph."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinloom.functions import text as X
from kinloom.functions import tokens as T
from kinloom.store import large

LABELS = {"S1": "Source 1 (Reference Corpus)", "S2": "Source 2 (Merchant Portal)", "S3": "Source 3 (Tax / Gov Registry)"}
FIRST_YEAR = 2021


def linked(entities: DataFrame, matches: DataFrame, records: DataFrame) -> DataFrame:
    """Each S1 entity with its sources in order, itself first: canonical_id, name, address, country, idx, source_id, source, raw_name, raw_address, confidence."""
    one = entities.select(F.col("entity_id").alias("canonical_id"), F.col("business_name").alias("name"), F.col("business_address").alias("address"), "country")
    own = one.select("*", F.lit(0).alias("place"), F.lit(0).cast("long").alias("ord"), F.col("canonical_id").alias("source_id"), F.lit("S1").alias("source"), F.col("name").alias("raw_name"), F.col("address").alias("raw_address"), F.lit(1.0).alias("confidence"))
    other = records.select(F.col("entity_id").alias("source_id"), "source", F.col("ord").cast("long").alias("ord"), F.col("business_name").alias("raw_name"), F.col("business_address").alias("raw_address"))
    hit = large(one).join(matches.select(F.col("s1").alias("canonical_id"), F.col("target").alias("source_id")).distinct(), "canonical_id").join(large(other), "source_id")
    conf = F.round(F.greatest(F.lit(0.72), F.least(F.lit(0.995), T.text_similarity("name", "raw_name") * 0.4 + 0.58)), 3)
    every = own.unionByName(hit.withColumns({"place": F.lit(1), "confidence": conf}))
    w = Window.partitionBy("canonical_id").orderBy("place", "source", "ord")
    return every.withColumn("idx", F.row_number().over(w) - 1).drop("place", "ord")


def alike(entities: DataFrame, matches: DataFrame) -> DataFrame:
    """Entities as ``linked`` has them, but with copies of themselves as sources: one copy where there is a match, as more copies have the same means."""
    more = matches.select(F.col("s1").alias("entity_id"), F.lit(1).alias("more")).distinct()
    idx = F.explode(F.sequence(F.lit(0), F.coalesce("more", F.lit(0)))).alias("idx")
    name, address = F.col("business_name"), F.col("business_address")
    return entities.join(large(more), "entity_id", "left").select(F.col("entity_id").alias("canonical_id"), name.alias("name"), address.alias("address"), idx, name.alias("raw_name"), address.alias("raw_address"))


def _door(x: str) -> Column:
    return F.lower(F.regexp_extract(x, r"\b(\d+[A-Za-z]?)\b", 1))


def evidence(sources: DataFrame) -> DataFrame:
    """One row an entity: four scores in percent, overall confidence, and risk flags.

    An entity with no second source has the fixed scores of a lone reference record.
    """
    c, s = _door("address"), _door("raw_address")
    door = F.when((c != "") & (s != ""), F.when(c == s, 1.0).otherwise(0.3)).when((c == "") & (s == ""), 0.9).otherwise(0.6)
    words = lambda a, b: F.array_distinct(F.regexp_extract_all(F.lower(F.concat_ws(" ", a, b)), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0)))
    cw, sw = words("name", "address"), words("raw_name", "raw_address")
    token = F.when(F.size(F.array_union(cw, sw)) == 0, 0.8).otherwise(T.jaccard(cw, sw))
    low = F.lower("raw_address")
    each = sources.select(
        "canonical_id", "idx", T.text_similarity("name", "raw_name").alias("n"), T.text_similarity("address", "raw_address").alias("a"), door.alias("b"), token.alias("t"),
        (F.contains(low, F.lit("rd")) | F.contains(low, F.lit("st"))).alias("street"), (~F.col("raw_address").rlike(r"\b\d{5,6}\b")).alias("no_postal"),
    )
    # Means are rounded to 9 places first, so that their last bits don't decide a half.
    mean = lambda k: F.bround(F.round(F.avg(F.when(F.col("idx") > 0, F.col(k))) * 100, 9), 0)
    g = each.groupBy("canonical_id").agg(F.count("*").alias("n_sources"), *[mean(k).alias(k) for k in "nabt"], F.bool_or("street").alias("street"), F.bool_or("no_postal").alias("no_postal"))
    lone = F.col("n_sources") <= 1
    clamp = lambda k, low: F.least(F.lit(100.0), F.greatest(F.lit(float(low)), F.col(k)))
    overall = F.bround(F.round(F.col("n") * 0.45 + F.col("a") * 0.25 + F.col("b") * 0.15 + F.col("t") * 0.15, 9), 1)
    flags = F.array_compact(F.array(F.when(F.col("a") < 75, "address divergence"), F.when(F.col("street"), "street abbreviation"), F.when(F.col("no_postal"), "no postal code")))
    return g.select(
        "canonical_id",
        "n_sources",
        F.when(lone, 98.0).otherwise(clamp("n", 50)).alias("name_similarity"),
        F.when(lone, 94.0).otherwise(clamp("a", 40)).alias("address_similarity"),
        F.when(lone, 100.0).otherwise(clamp("b", 50)).alias("building_match"),
        F.when(lone, 96.0).otherwise(clamp("t", 45)).alias("token_agreement"),
        F.when(lone, 97.2).otherwise(overall).alias("overall"),
        F.when(lone, F.array().cast("array<string>")).otherwise(flags).alias("risk_flags"),
    )


def conflicts(ev: DataFrame) -> DataFrame:
    """conflict_type and status from the clamped scores."""
    apart = (F.col("name_similarity") >= 80) & (F.col("address_similarity") < 65)
    merged = (F.col("n_sources") > 3) & (F.col("address_similarity") < 72)
    return ev.select(
        "canonical_id",
        (apart | merged).alias("has_conflict"),
        F.when(apart, "SPATIAL_OR_ADDRESS_DIVERGENCE").when(merged, "MULTI_SOURCE_OVER_MERGE_RISK").otherwise("NONE").alias("conflict_type"),
        F.when(apart, "NEEDS_REVIEW").when(merged, "BORDERLINE_REVIEW").otherwise("AUTO_MATCHED").alias("status"),
    )


def timeline(sources: DataFrame) -> DataFrame:
    """A row for each source in order, years from FIRST_YEAR on, and one for the consensus."""
    label = F.element_at(F.create_map(*[F.lit(v) for k, name in LABELS.items() for v in (k, name.split(" (")[0])]), F.col("source"))
    seen = sources.select("canonical_id", (F.lit(FIRST_YEAR) + F.col("idx")).alias("year"), F.concat(F.lit("Observed in "), label).alias("title"), F.col("raw_name").alias("recorded_name"), X.shorten("raw_address", 60).alias("recorded_address"), "source_id")
    last = sources.filter("idx = 0").select("canonical_id", F.lit(2026).alias("year"), F.lit("Consolidated profile").alias("title"), F.col("name").alias("recorded_name"), F.lit("Consensus address").alias("recorded_address"), F.lit("CANONICAL-UNIFIED").alias("source_id"))
    return seen.unionByName(last)


def aliases(sources: DataFrame, most: int = 5) -> DataFrame:
    """canonical_id, aliases: the first distinct names in source order."""
    names = F.transform(F.array_sort(F.collect_list(F.struct("idx", "raw_name"))), lambda x: x["raw_name"])
    return sources.groupBy("canonical_id").agg(F.slice(F.array_distinct(names), 1, most).alias("aliases"))


def passports(sources: DataFrame, ev: DataFrame, conflict: DataFrame) -> DataFrame:
    """canonical_id and a JSON document of the entity."""
    ids = F.transform(F.array_sort(F.collect_list(F.struct("idx", "source_id"))), lambda x: x["source_id"])
    cover = sources.groupBy("canonical_id").agg(F.first("name").alias("name"), F.first("address").alias("address"), F.first("country").alias("country"), ids.alias("sources"))
    full = cover.join(ev, "canonical_id").join(conflict, "canonical_id").join(aliases(sources), "canonical_id")
    doc = F.to_json(F.struct(F.lit("1.0").alias("version"), F.col("canonical_id").alias("entity_id"), "name", "address", "country", F.concat(F.col("overall").cast("string"), F.lit("%")).alias("confidence"), F.col("status").alias("conflict_status"), "aliases", "sources"))
    return full.select("canonical_id", doc.alias("passport"))


def graph_nodes(sources: DataFrame) -> DataFrame:
    """canonical_id, node_id, type, label."""
    head = sources.filter("idx = 0")
    mark = X.landmark("address")
    node = lambda df, pre, kind, label: df.select("canonical_id", F.concat(F.lit(pre), F.col("canonical_id")).alias("node_id"), F.lit(kind).alias("type"), label.alias("label"))
    parts = [
        node(head, "node-", "canonical", F.col("name")),
        sources.select("canonical_id", F.concat(F.lit("node-src-"), F.col("source_id")).alias("node_id"), F.lit("source_record").alias("type"), F.col("raw_name").alias("label")),
        node(head, "node-addr-", "address", F.col("address")),
        node(head.filter(mark != ""), "node-land-", "landmark", mark),
        node(aliases(sources), "node-alias-", "alias_cluster", F.array_join(F.slice("aliases", 1, 3), " | ")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def graph_edges(sources: DataFrame, conflict: DataFrame) -> DataFrame:
    """canonical_id, source, target, relation."""
    canon = lambda pre: F.concat(F.lit(pre), F.col("canonical_id"))
    rel = F.when(F.col("idx") == 0, "CANONICAL_SOURCE").when(F.col("has_conflict"), "POSSIBLE_BRANCH / REVIEW").when(F.col("confidence") >= 0.90, "SAME_ENTITY").when(F.col("confidence") >= 0.75, "ALIAS_OF").otherwise("POSSIBLE_RELATION")
    one = sources.join(conflict, "canonical_id").select("canonical_id", F.concat(F.lit("node-src-"), F.col("source_id")).alias("source"), canon("node-").alias("target"), rel.alias("relation"))
    head = sources.filter("idx = 0")
    edge = lambda df, a, b, r: df.select("canonical_id", canon(a).alias("source"), canon(b).alias("target"), F.lit(r).alias("relation"))
    more = edge(head, "node-", "node-addr-", "SHARED_ADDRESS").unionByName(edge(head.filter(X.landmark("address") != ""), "node-addr-", "node-land-", "PROXIMITY_LANDMARK")).unionByName(edge(head, "node-", "node-alias-", "ALIAS_OF"))
    return one.unionByName(more)
