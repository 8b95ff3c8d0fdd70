"""Metrics, rules, validation, search, review and readers on written cases."""

import json
import unicodedata

import pytest
from pyspark.sql import functions as F

from kinloom.functions import text
from kinloom.operators import blocking, decide, evaluate, explain, features, geo, model, profiles, review, search, validate
from kinloom.sources import readers, sinks


def _pairs(spark, rows):
    return spark.createDataFrame(rows, "s1 string, target string")


@pytest.mark.parametrize(
    ("truth", "predicted", "f"),
    [(["S2-1", "S3-2"], ["S2-1", "S2-9", "S3-2"], 0.714), (["a", "b"], ["a", "b", *map(str, range(8))], 0.238), ([], [], 1.0), ([], ["x"], 0.0), (["x"], [], 0.0), (["x"], ["y"], 0.0)],
)
def test_entity_f(spark, truth, predicted, f):
    s1 = spark.createDataFrame([("e",)], "s1 string")
    got = evaluate.per_entity(s1, _pairs(spark, [("e", p) for p in predicted]), _pairs(spark, [("e", t) for t in truth])).first()
    assert got.f == pytest.approx(f, abs=6e-4)
    assert got.exact == int(set(truth) == set(predicted))


@pytest.mark.parametrize(("p", "exact", "given", "house", "match"), [(0.75, 0, 0, 0, 1), (0.70, 0, 1, 0, 1), (0.70, 0, 0, 0, 0), (0.60, 1, 0, 0, 1), (0.60, 0, 1, 0, 0), (0.60, 0, 1, 1, 1), (0.579, 1, 1, 1, 0)])
def test_shipped_rule(spark, p, exact, given, house, match):
    row = spark.createDataFrame([(p, float(exact), float(1 - given), 0.0, float(house))], "score double, name_exact_match double, s1_addr_missing double, cand_addr_missing double, addr_house_number_match double")
    assert decide.agreement_shipped(row).count() == match


def test_margin_rule(spark):
    rows = spark.createDataFrame([("a", 0.9), ("a", 0.66), ("a", 0.64), ("b", 0.7), ("b", 0.59)], "s1 string, score double")
    assert sorted(tuple(r) for r in decide.margin(rows).collect()) == [("a", 0.66), ("a", 0.9), ("b", 0.7)]


def test_caps(spark):
    rows = spark.createDataFrame([("a", f"t{i}", "S2", i, 2 if i % 2 else 1) for i in range(10)], "s1 string, target string, target_source string, target_ord long, n_blocks int")
    assert blocking.cap_multi_single(rows, 3, 1).count() == 4
    assert {r.target for r in blocking.cap_total(rows, 6).collect()} == {"t1", "t3", "t5", "t7", "t9", "t0"}
    assert blocking.adaptive_top(rows, 2).count() == 7
    labelled = rows.withColumn("label", F.when(F.col("target") == "t0", 1).otherwise(0))
    assert blocking.hard_negatives(labelled, 4).count() == 5
    assert blocking.hard_negatives(labelled.withColumn("label", F.lit(0)), 4).count() == 2


def test_invariants(spark):
    from kinloom.plans import linkage_queries as L
    from kinloom.plans.views import records

    sf = "/root/testdata/sf0.001"
    found = L.scored(spark, sf).cache()
    matched = decide.agreement_shipped(found)
    assert matched.join(found, ["s1", "target"], "left_anti").count() == 0
    lists = L.er_match_lists(spark, sf).collect()
    assert len(lists) == len({r.entity_id for r in lists}) == records(spark, sf).filter("source = 'S1'").count()
    assert found.filter("score < 0 OR score > 1 OR name_char_sim > 1").count() == 0
    assert found.groupBy("s1", "target").count().filter("count > 1").count() == 0


def test_validator_faults(spark):
    s1 = spark.createDataFrame([("S1-1",), ("S1-2",)], "s1 string")
    lists = spark.createDataFrame([("S1-1", "S2-1,S2-1,S1-5,Q-1"), ("S1-1", ""), ("S1-9", "S3-7")], "s1 string, ids string")
    got = {r.rule: (r.severity, r.n) for r in validate.submission(lists, s1, spark.createDataFrame([("S2-1",)], "target string")).collect()}
    assert got == {"duplicate S1 rows": ("error", 1), "repeated ids in a list": ("error", 1), "S1 ids in lists": ("error", 1), "bad id prefix": ("error", 1), "missing S1": ("error", 1), "foreign S1": ("error", 1), "unknown ids": ("error", 3), "no candidate file": ("warning", 1)}
    assert validate.header("a\tb", ("a", "b")) == []
    assert validate.header("a,b", ("a", "b")) == ["header isn't tab separated"]
    assert validate.header("a\tc", ("a", "b")) == ["wrong header"]


QUERIES = [
    ("near PSG college tea shop", "latin", "tea shop", "PSG college", "food_dining"),
    ("Shri medicals near bus stand", "latin", "Shri medicals", "bus stand", "healthcare"),
    ("restarant near gandhipurm", "latin", "restaurant", "gandhipuram", "food_dining"),
    ("Apollo pharmacy opposite hospital", "latin", "Apollo pharmacy", "hospital", "healthcare"),
    ("boulangerie près de rue de la paix", "latin", "boulangerie", "rue de la paix", "food_dining"),
    ("கல்லூரி பக்கத்துல நல்ல சாப்பாடு", "tamil", "நல்ல சாப்பாடு", "கல்லூரி", "food_dining"),
    ("एमआईडीसी के पास एग्रो इंडस्ट्रीज", "hindi", "एग्रो इंडस्ट्रीज", "एमआईडीसी", "general"),
    ("plain words", "latin", "plain words", "", "general"),
]


def test_query_parser(spark):
    rows = spark.createDataFrame([(i, q[0]) for i, q in enumerate(QUERIES)], "i int, text string")
    for r in search.parse_query(rows).collect():
        _, script, business, place, category = QUERIES[r.i]
        assert (r.script, r.business, r.landmark, r.category) == (script, business, place, category)


def test_bm25_prefix(spark):
    docs = spark.createDataFrame([(1, "tea shop"), (2, "teapot shop shop"), (3, "car")], "doc_id long, text string")
    asked = spark.createDataFrame([(7, "tea"), (8, "t")], "q long, text string")
    got = search.bm25(search.index(docs, "doc_id", ["text"]), search.query_terms(asked, "q", "text"))
    assert {(r["query"], r.doc) for r in got.collect()} == {(7, 1), (7, 2), (8, 1), (8, 2)}


def test_review(spark):
    actions = spark.createDataFrame([("a", "separated", None, "", 1), ("a", "what", "Z", "why", 2)], "canonical_id string, decision string, reviewer string, reason string, ts int")
    log = review.submit(spark.createDataFrame([], "canonical_id string, decision string, reviewer string, reason string, ts int"), actions)
    assert [(r.decision, r.reviewer, r.reason) for r in log.orderBy("ts").collect()] == [("SEPARATED", "Admin Reviewer", "Manual adjudication: marked as SEPARATED"), ("CONFIRMED", "Z", "why")]
    assert review.latest(log, "canonical_id", "ts", "ts").first().decision == "CONFIRMED"


def test_lone_record_evidence(spark):
    r = spark.createDataFrame([("S1-1", "S1", 1, "Acme", "1 Road", "X")], "entity_id string, source string, ord long, business_name string, business_address string, country string")
    sources = explain.linked(r, spark.createDataFrame([], "s1 string, target string"), r)
    e = explain.evidence(sources).first()
    assert (e.name_similarity, e.address_similarity, e.building_match, e.token_agreement, e.overall) == (98.0, 94.0, 100.0, 96.0, 97.2)
    assert json.loads(explain.passports(sources, explain.evidence(sources), explain.conflicts(explain.evidence(sources))).first().passport)["confidence"] == "97.2%"


def test_geo(spark):
    row = spark.range(1).select(geo.haversine(F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(1.0)).alias("km"), geo.bearing(F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(1.0)).alias("b"), geo.compass(F.lit(350.0)).alias("c")).first()
    assert row.km == pytest.approx(111.19, abs=0.01)
    assert row.b == pytest.approx(90.0)
    assert row.c == "N"


def test_files(spark, tmp_path):
    rows = [("S1-1", 'A "quoted" name', "", "IN"), ("S2-2", "B\\x", "x, y", "US")]
    df = spark.createDataFrame(rows, "entity_id string, business_name string, business_address string, country string")
    sinks.tsv(df.coalesce(1), str(tmp_path / "t"))
    back = readers.records(spark, str(tmp_path / "t"))
    assert sorted(tuple(r)[:4] for r in back.collect()) == sorted(rows)
    assert {r.source for r in back.collect()} == {"S1", "S2"}
    assert [r.id for r in readers.first_column(spark, str(tmp_path / "t")).collect()] == ["S1-1", "S2-2"]
    sinks.parquet(df, str(tmp_path / "p"), "country")
    assert readers.parquet(spark, str(tmp_path / "p")).count() == 2
    sinks.quoted_csv(df, str(tmp_path / "c"))
    sinks.thresholds({"high_threshold": 0.8}, str(tmp_path / "t.json"))
    assert readers.thresholds(str(tmp_path / "t.json"))["high_threshold"] == 0.8
    assert readers.thresholds(None)["optimal_threshold"] == 0.4365
    (tmp_path / "dataset" / "train").mkdir(parents=True)
    assert readers.data_dir(base=str(tmp_path)) == str(tmp_path / "dataset")
    with pytest.raises(FileNotFoundError):
        readers.data_dir(base=str(tmp_path / "p" / "q" / "r" / "s"))


def test_batch_input(spark):
    rows = spark.createDataFrame([('[{"raw_name": "A", "address": "r"}, {"id": "x", "name": "B", "country": "US"}]',), ("C, road 1, FR\n\nD",)], "body string")
    got = sorted(tuple(r) for r in readers.batch_input(rows).collect())
    assert got == [("ROW-101", "A", "r", "India"), ("ROW-101", "C", "road 1", "FR"), ("ROW-102", "D", "", "India"), ("x", "B", "", "US")]


def test_model(spark):
    rows = spark.createDataFrame([(f"e{i % 9}", f"t{i}", i % 2, float(i % 2) + (i % 5) / 10, float(i % 3)) for i in range(90)], "s1 string, target string, label int, a double, b double")
    fitted = model.train(rows, ["a", "b"], trees=3, depth=2)
    assert model.score(fitted, rows, ["a", "b"]).filter("label = 1 AND score < 0.5").count() == 0
    assert {r.feature for r in model.importance(fitted, ["a", "b"], spark).collect()} == {"a", "b"}
    truth = rows.filter("label = 1").select("s1", "target")
    out = model.ablation(rows, {"both": ["a", "b"], "one": ["b"]}, rows.select("s1").distinct(), truth, [0.3, 0.5], trees=2, depth=2).collect()
    assert {r.model: r.n_features for r in out} == {"both": 2, "one": 1}


def test_folded_keys(spark):
    """Names that aren't ASCII: keys of each generator beside the standard library's decomposition."""
    names = ["Société Générale", "Café Zürich SARL", "हिन्दी भवन", "Ångström Ünit", "ﬁne Straße", "", None]
    rows = [(f"S2-{i}", "S2", i, n, "12/034 Allée Fleury, 75001 Paris", "France") for i, n in enumerate(names)]
    records = spark.createDataFrame(rows, "entity_id string, source string, ord long, business_name string, business_address string, country string")

    def plain(s):
        return " ".join("".join(c if unicodedata.category(c)[0] in "LN" or c in "_ " else " " for c in s).lower().split())

    decomposed = lambda s: unicodedata.normalize("NFKD", s)
    latin = lambda s: unicodedata.normalize("NFKC", "".join(c for c in decomposed(s) if not "\u0300" <= c <= "\u036f"))
    unmarked = lambda s: "".join(c for c in decomposed(s) if not unicodedata.combining(c))
    for generator, how in (("narrow", decomposed), ("serve", latin)):
        found = {r.entity_id: r.key for r in blocking.keys(records, generator, ["B1"]).collect()}
        assert found == {f"S2-{i}": f"FRANCE|B1|{plain(how(n))}" for i, n in enumerate(names) if n}
    found = {r.entity_id: r.key for r in blocking.keys(records, "pairing", ["p_G"]).collect()}
    wanted = {}
    for i, n in enumerate(names):
        if n and any("\u0900" <= c <= "\u0d7f" for c in n):
            wanted[f"S2-{i}"] = "FRANCE|p_G|indic_" + "".join(c for c in n if unicodedata.category(c)[0] in "LMN")[:6]
        elif n and not n.isascii() and len(plain(unmarked(n)).split()) >= 2:
            wanted[f"S2-{i}"] = "FRANCE|p_G|lat_" + "_".join(plain(unmarked(n)).split()[:2])
    assert found == wanted
    assert profiles.profile_v2(records).filter("entity_id = 'S2-0'").first().name == "societe generale"
    assert profiles.profile_v1(records).filter("entity_id = 'S2-0'").first().name == "socie te ge ne rale"


def test_all_compounds_give_keys(spark):
    records = spark.createDataFrame([("S2-1", "S2", 1, "x", "1/2 3-4 5_6 7/08 9/10 11/12", "US")], "entity_id string, source string, ord long, business_name string, business_address string, country string")
    found = {r.key for r in blocking.keys(records, "pairing", ["w_A"]).collect()}
    assert found == {f"US|w_A|cmp_{c}" for c in ("1_2", "3_4", "5_6", "7_8", "9_10", "11_12")}


def test_places(spark):
    rows = [("5 Rue X, Nouvelle-Aquitaine", "France"), ("Navi Mumbai", "India"), ("Iowa City", "US"), ("nowhere", "France"), (None, "US"), ("nowhere", None)]
    at = spark.createDataFrame(rows, "address string, country string").select(text.coordinates("address", "country").alias("at"))
    assert [tuple(r["at"]) for r in at.collect()] == [(45.2444, 0.1772), (19.0760, 72.8777), (41.6611, -91.5302), (46.2276, 2.2137), (37.0902, -95.7129), (0.0, 0.0)]


def test_search_by_id(spark):
    entities = spark.createDataFrame([("S1-1",), ("S1-22",)], "entity_id string")
    asked = spark.createDataFrame([("a", "show s1-22, please"), ("b", "S1-9"), ("c", "xS1-1"), ("d", None), ("e", "S1-1 or S1-22")], "id string, text string")
    assert sorted(tuple(r) for r in search.named(asked, "id", "text", entities).collect()) == [("a", "S1-22"), ("e", "S1-1")]


@pytest.mark.parametrize(("cells", "n", "digits"), [(2, 300, 1), (16, 2000, 17), (256, 40, 17), (256, 5, 0)])
def test_curve_in_cells(spark, monkeypatch, cells, n, digits):
    """Cumulated counts over cells of scores are those of one sorted pass, with ties and without."""
    import random

    monkeypatch.setattr(evaluate, "CELLS", cells)
    r = random.Random(n)
    rows = [(round(r.random(), digits), int(r.random() < 0.3)) for _ in range(n)]
    scored = spark.createDataFrame(rows, "score double, label int")
    want, positives = [], sum(label for _, label in rows)
    for s in sorted({s for s, _ in rows}):
        above = [label for t, label in rows if t >= s]
        want.append((s, sum(above), len(above) - sum(above), positives))
    assert sorted(tuple(x) for x in evaluate.curve(scored).collect()) == want
    down, area, ap, last = want[::-1], 0.0, 0.0, (0, 0)
    for _, tp, fp, _ in down:
        area += (fp - last[1]) * (tp + last[0]) / 2
        ap += (tp - last[0]) / positives * tp / (tp + fp) if positives else 0
        last = (tp, fp)
    got = evaluate.average_precision(scored).first()
    size = positives * (n - positives)
    assert got.average_precision == pytest.approx(ap)
    assert got.roc_auc == pytest.approx(area / size if size else 0)


def test_early_features(spark):
    """Written pairs: a domain beside its name, compound numbers, prefixes, and two empty records."""
    rows = [
        ("S1-1", "S1", 1, "www.société.co.in/shop", "Flat 12, 010/2A Main Road Lyon", "fr"),
        ("S2-1", "S2", 2, "Dr. Socie Te Ltd.", "10-2A Lyon", "FR "),
        ("S1-2", "S1", 3, "", "", ""),
        ("S2-2", "S2", 4, "", None, None),
        ("S1-3", "S1", 5, "The Dr", "x", "US"),
    ]
    r = spark.createDataFrame(rows, "entity_id string, source string, ord long, business_name string, business_address string, country string")
    p = {x.entity_id: x for x in profiles.profile_early(r).collect()}
    assert p["S1-1"].name == "socie te" and p["S1-1"].compact == "societe"
    assert p["S1-1"].numbers == ["10/2A", "12", "10"] and p["S1-1"].building == "10/2A" and p["S1-1"].localities == ["lyon"]
    assert p["S2-1"].name_words == ["socie", "te"] and p["S2-1"].numbers == ["10/2A", "10"]
    assert p["S1-3"].name_words == [] and p["S1-3"].first == "the"
    pairs = spark.createDataFrame([("S1-1", "S2-1"), ("S1-2", "S2-2")], "s1 string, target string")
    f = {x.s1: x for x in features.features_early(pairs, profiles.profile_early(r)).collect()}
    assert len(features.EARLY) == 33 and set(features.EARLY) < set(f["S1-1"].asDict())
    a, b = f["S1-1"], f["S1-2"]
    assert (a.name_token_jaccard, a.addr_house_number_match, a.country_match, a.addr_locality_jaccard) == (1.0, 1.0, 1.0, 1.0)
    assert (b.name_levenshtein_sim, b.addr_levenshtein_sim, b.country_match, b.addr_house_number_match, b.name_addr_combined_sim) == (1.0, 0.0, 0.0, -1.0, 0.55)
