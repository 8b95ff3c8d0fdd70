"""What the search queries send to the driver, and the words and copies that they count once."""

import pytest
from pyspark.sql import functions as F

from kinloom import catalog, store
from kinloom.operators import copies, decide, explain, features, profiles, search

SF = "/root/testdata/sf0.001"


def _plans(spark, monkeypatch, name):
    """The plans of all tables that the query writes and of its result, where no counted table is small enough for a broadcast."""
    seen = []

    def spied(df, name):
        seen.append(df._jdf.queryExecution().executedPlan().toString())
        return store.keep(df, name)

    monkeypatch.setattr(store, "BROADCAST_BYTES", 0)
    monkeypatch.setattr(search, "keep", spied)
    monkeypatch.setattr(copies, "keep", spied)
    seen.append(catalog.queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString())
    return seen


@pytest.mark.parametrize("name", ["batch_resolve", "batch_summary", "entity_search"])
def test_no_table_is_broadcast_uncounted(spark, monkeypatch, name):
    """By the size of compressed files Spark would send the postings to the driver, hundreds of times as large there."""
    assert spark.conf.get("spark.sql.autoBroadcastJoinThreshold") in ("10485760", "10485760b", "10MB")
    plans = _plans(spark, monkeypatch, name)
    assert len(plans) > 3
    assert not [p for p in plans if "BroadcastHashJoin" in p]


def test_terms_meet_words_by_prefix(spark):
    """Terms of many lengths and one beginning, one of a single character, and an empty text that meets nothing."""
    docs = spark.createDataFrame([(f"d{i:03}", f"s1 s1{i} {'anvil' * (i % 3)}works x") for i in range(60)], "doc string, text string")
    terms = ["s1", "s11", "s123", "s1234567", "anvil", "anvilan", "works", "x", "w", ""]
    asked = spark.createDataFrame([(f"q{i}", t) for i, t in enumerate(terms)], "query string, q string")
    per, df, whole = search._weighed(search.index(docs, "doc", ["text"]), asked, True)
    texts = {r.doc: r.text.split() for r in docs.collect()}
    brute = sorted((t, d, 4, sum(w.startswith(t) for w in ws)) for t in terms if t for d, ws in texts.items() if any(w.startswith(t) for w in ws))
    assert sorted((r.q, r.doc, r.length, r.tf) for r in per.collect()) == brute
    assert {r.q: r.df for r in df.collect()} == {t: sum(b[0] == t for b in brute) for t in {b[0] for b in brute}}


def test_many_terms_of_one_beginning(spark):
    """30,000 ids asked for and 30,000 words that begin alike are 900 million pairs by their first two letters."""
    words = spark.range(30_000).selectExpr("concat('d', id) AS doc", "concat('s1', id * 2) AS text")
    asked = spark.range(30_000).selectExpr("concat('q', id) AS query", "concat('s1', 500000 + id) AS q")
    per, _, _ = search._weighed(search.index(words, "doc", ["text"]), asked, True)
    plan = per._jdf.queryExecution().optimizedPlan().toString()
    assert "bucket" not in plan and per.count() == 0


def test_evidence_of_copies_is_found_once_a_class(spark):
    """``alike`` of classes, dealt to the members, beside each entity with as many copies as it has sources."""
    rows = [(f"S{i % 3 + 1}-{i}", f"S{i % 3 + 1}", i, ["red anvil works", "blue forge", "green mill"][i // 3 % 3], ["12 mill road 40001", "", "7 oak st"][i % 7 % 3], "IN", f"t{i // 3 % 3}") for i in range(60)]
    r = spark.createDataFrame(rows, "entity_id string, source string, ord long, business_name string, business_address string, country string, truth_key string")
    found, of = copies.classes(r, "truth_key")
    scored = features.features_v2(copies.candidates(found), profiles.profile_v2(found)).withColumn("score", features.linear_score())
    pairs = decide.agreement_shipped(scored)
    got = copies.each(explain.evidence(explain.alike(found.filter("n1 > 0"), pairs)), of)
    linked = explain.linked(r.filter("source = 'S1'"), copies.members(pairs, of), r).withColumns({"raw_name": F.col("name"), "raw_address": F.col("address")})
    columns = ["canonical_id", "overall", "name_similarity"]
    every = sorted(map(tuple, explain.evidence(linked).select(columns).collect()))
    assert sorted(map(tuple, got.select(columns).collect())) == every and len(every) == 20
