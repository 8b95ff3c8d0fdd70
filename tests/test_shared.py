"""Counts of pairs by shared keys, beside the pairs."""

from pyspark.sql import functions as F

from kinloom.operators import blocking, evaluate, shared
from kinloom.plans import linkage_queries as L

SCHEMA = "entity_id string, source string, ord long, business_name string, business_address string, country string, truth_key string"
UNIONS = L.SINGLE | L.UNIONS


def _records(spark):
    """Names and addresses that meet in several ways, and ids of several records."""
    names, places = ["red anvil works", "red anvil", "blue f0rge", "blue forge", "redanvilworks.com", ""], ["12 mill road 40001", "12 mill", "7 oak lane", "", None]
    rows = [(f"S{i % 3 + 1}-{i}", f"S{i % 3 + 1}", i, names[i * 7 % 6], places[i * 11 % 5], "IN" if i % 4 else "FR", None if i % 9 == 0 else f"t{i * 5 % 13}") for i in range(90)]
    more = [(f"S{s}-900", f"S{s}", 900 + i, names[i], places[i % 4], "IN", f"t{i}") for s in (1, 2) for i in range(6)]
    return spark.createDataFrame(rows + more, SCHEMA)


def _truth(r):
    one, two = r.filter("source = 'S1'").select(F.col("entity_id").alias("s1"), "truth_key"), r.filter("source <> 'S1'").select(F.col("entity_id").alias("target"), "truth_key")
    return one.join(two, "truth_key").select("s1", "target")


def _rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_counts_are_those_of_the_pairs(spark):
    r = _records(spark)
    s1, k = r.filter("source = 'S1'").select(F.col("entity_id").alias("s1")), blocking.keys(r, "serve")
    pairs = blocking.hits(k.filter("source = 'S1'"), k.filter("source <> 'S1'")).select(F.col("block").alias("strategy"), "s1", "target")
    tally = shared.counts(shared.posted(r), UNIONS | {shared.TRUTH: [shared.TRUTH]}).localCheckpoint()
    true = F.col("strategy") == shared.TRUTH
    got = evaluate.blocking_counts(s1, tally.filter(~true), tally.filter(true))
    assert _rows(got) == _rows(evaluate.blocking_metrics(s1, evaluate.with_unions(pairs, L.UNIONS), _truth(r)))


def test_wide_classes_meet_one_by_one(spark, monkeypatch):
    post = shared.posted(_records(spark))
    whole = _rows(shared.counts(post, UNIONS).groupBy("strategy", "n", "found").agg(F.sum("times")))
    for most in (0, 4):
        monkeypatch.setattr(shared, "WIDE", most)
        assert _rows(shared.counts(post, UNIONS).groupBy("strategy", "n", "found").agg(F.sum("times"))) == whole


def test_candidate_counts_after_pruning(spark):
    r = _records(spark).filter("ord < 900")
    s1 = r.filter("source = 'S1'").select(F.col("entity_id").alias("s1"))
    tally = shared.counts(shared.posted(r, most=4), {"all": L.SERVE, shared.TRUTH: [shared.TRUTH]}).localCheckpoint()
    got = evaluate.candidate_counts(s1, tally.filter("strategy = 'all'"), tally.filter(F.col("strategy") == shared.TRUTH))
    assert _rows(got) == _rows(evaluate.candidate_stats(s1, blocking.candidates(r, most=4), _truth(r)))


def test_large_groups_are_not_paired(spark):
    """900 million pairs in one group."""
    r = spark.range(90_000).selectExpr("concat('S', id % 3 + 1, '-', id) AS entity_id", "concat('S', id % 3 + 1) AS source", "id AS ord", "'red anvil works' AS business_name", "'12 mill road' AS business_address", "'IN' AS country", "'t' AS truth_key")
    found = shared.counts(shared.posted(r), L.UNIONS).collect()
    assert {x.strategy: (x.n, x.found, x.times) for x in found} == {"old union": (60_000, 60_000, 30_000), "union": (60_000, 60_000, 30_000)}


def test_first_targets_of_copies(spark):
    """Classes of many members give the first ten targets in source order, as the pairs of records do."""
    from pyspark.sql import Window

    from kinloom.operators import copies

    r = _records(spark).filter("ord < 900")
    found, of = copies.classes(r)
    pairs = found.filter("n1 > 0").select(F.col("entity_id").alias("s1"), "country").join(found.filter("n2 > 0").select(F.col("entity_id").alias("target"), "country"), "country")
    got = copies.first_targets(pairs, of, 10).select("s1", "target", "rank")
    w = Window.partitionBy("s1").orderBy("target_source", "target_ord")
    two = r.filter("source <> 'S1'").selectExpr("entity_id AS target", "source AS target_source", "ord AS target_ord", "country")
    every = r.filter("source = 'S1'").selectExpr("entity_id AS s1", "country").join(two, "country").withColumn("rank", F.row_number().over(w)).filter("rank <= 10").select("s1", "target", "rank")
    assert _rows(got) == _rows(every) != []


def test_pairs_of_copies_are_those_of_records(spark):
    from kinloom.operators import copies

    r = _records(spark).filter("ord < 900")
    found, of = copies.classes(r, "truth_key")
    pairs = copies.candidates(found, most=4)
    got = copies.members(pairs, of, "n_blocks", "blocks", "label")
    plain = blocking.label(blocking.candidates(r, most=4), _truth(r)).select("s1", "target", "target_source", "target_ord", "n_blocks", "blocks", "label")
    assert _rows(got) == _rows(plain) != []
    assert pairs.agg(F.sum(F.col("n1") * F.col("n2"))).first()[0] == plain.count()


def test_kinds_of_documents_rank_as_documents(spark):
    """2,000 documents of five kinds: each kind is weighed once, and ties go by id as before."""
    from kinloom.operators import search

    docs = spark.createDataFrame([(f"d{i:04}", ["red anvil", "red red forge", "blue anvil works", "green", "anvil"][i % 5] + f" n{i:04}") for i in range(2000)], "doc_id string, text string")
    asked = search.query_terms(spark.createDataFrame([("a", "red anvil"), ("b", "anvil works"), ("c", "none"), ("d", "re bl n0001")], "q string, text string"), "q", "text")
    postings = search.index(docs, "doc_id", ["text"])
    plain = search.top(search.bm25(postings, asked).withColumn("score", F.round("score", 9)), 7)
    assert _rows(search.best(postings, asked, 7).select("query", "doc", "score", "rank")) == _rows(plain.select("query", "doc", "score", "rank")) != []


def test_sweep_of_classes_is_that_of_records(spark):
    """A class of three S1 records with two of three true targets, and a lone one with a wrong target."""
    sizes = spark.createDataFrame([("a", 3, 3), ("b", 1, 0)], "s1 string, times long, n_true long")
    scores = spark.createDataFrame([("a", "x", 1, 0.9, 2), ("a", "y", 0, 0.5, 4), ("b", "y", 0, 0.5, 4)], "s1 string, target string, label int, score double, n2 long")
    ones, s1 = [f"a{i}" for i in range(3)], spark.createDataFrame([(s,) for s in ("a0", "a1", "a2", "b")], "s1 string")
    pairs = [(s, f"x{i}", 0.9) for s in ones for i in range(2)] + [(s, f"y{i}", 0.5) for s in (*ones, "b") for i in range(4)]
    truth = spark.createDataFrame([(s, t) for s in ones for t in ("x0", "x1", "z")], "s1 string, target string")
    plain = evaluate.sweep(s1, spark.createDataFrame(pairs, "s1 string, target string, score double"), truth, [0.3, 0.7, 0.95])
    assert _rows(evaluate.sweep_classes(sizes, scores, [0.3, 0.7, 0.95])) == _rows(plain)
