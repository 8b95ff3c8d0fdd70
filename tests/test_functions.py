"""Text, token and similarity functions on written cases, Unicode included."""

import random
import unicodedata

import pytest
from pyspark.sql import functions as F

from kinloom import catalog
from kinloom.functions import text as X
from kinloom.functions import tokens as T


def _one(spark, column, **values):
    row = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values)).select(column.alias("v")).first()
    return row.v


@pytest.mark.parametrize(("text", "v1", "v2"), [("Société d'Été", "socie te d e te", "societe d ete"), ("ABC  Ltd.", "abc ltd", "abc ltd"), ("हिन्दी", "ह न द", "ह न द"), ("", "", ""), ("a_b", "a_b", "a_b")])
def test_normal_forms(spark, text, v1, v2):
    assert _one(spark, X.norm_name(X.fold("x", "nfkd")), x=text) == v1
    assert _one(spark, X.norm_name(X.fold("x", "latin")), x=text) == v2


def test_fold_against_unicodedata(spark):
    r = random.Random(1)
    texts = ["".join(chr(r.choice([r.randint(32, 126), r.randint(0xC0, 0x24F), r.randint(0x900, 0x97F)])) for _ in range(12)) for _ in range(60)]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, x string").select("i", X.fold("x", "marks").alias("v")).collect()
    for row in rows:
        assert row.v == "".join(c for c in unicodedata.normalize("NFKD", texts[row.i]) if not unicodedata.combining(c))


def test_nfkd_fold_takes_whole_texts(spark, tmp_path):
    texts = ["Société d'Été\nÀ la  carte!\n\nNaïve ½ ﬁn", "plain line\r\nsecond_line, third\n", "हिन्दी\nÑandú", "\nonly the second line: Ünï", "", None]
    spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string").write.parquet(f"{tmp_path}/documents.parquet")
    latin = lambda d: unicodedata.normalize("NFKC", "".join(c for c in d if not "\u0300" <= c <= "\u036f"))
    plain = lambda s: " ".join("".join(c if unicodedata.category(c)[0] in "LN" or c in "_ \t\n\x0b\f\r" else " " for c in s).lower().split())
    found = {r.doc_id: (r.v1, r.v2, r.unmarked) for r in catalog.queries()["nfkd_fold"](spark, str(tmp_path)).collect()}
    assert len(found) == len(texts)
    for i, text in enumerate(texts):
        d = unicodedata.normalize("NFKD", text) if text is not None else None
        assert found[i] == ((plain(d), plain(latin(d)), "".join(c for c in d if not unicodedata.combining(c)).lower()) if text is not None else (None, None, None))


@pytest.mark.parametrize(("text", "want"), [("0010", "10"), ("000", "0"), ("a1", "a1"), ("", ""), ("7", "7")])
def test_numbers(spark, text, want):
    assert _one(spark, X.norm_number("x"), x=text) == want


def test_compound_and_address(spark):
    assert _one(spark, X.compound_numbers("x"), x="at 010/2 and 45-48") == ["10_2", "45_48"]
    assert _one(spark, X.norm_address("x"), x="0123 Main Street, Suite 4B, New York 10001") == "123 main street 4b new york 10001"
    assert _one(spark, X.norm_address("x"), x="14 r de la paix, Paris Cedex 02") == "14 rue de la paix paris cedex 2"
    assert _one(spark, X.norm_address("x"), x="Plot No. 45/48, GIDC Industrial Area, Surat") == "45 48 gidc industrial area surat"


@pytest.mark.parametrize(("text", "want"), [("trinitycatholicchurch.com", "trinitycatholicchurch"), ("www.amazon.in/shop", "amazon"), ("Plain Name", "Plain Name"), ("https://www.x.org", "x")])
def test_domain(spark, text, want):
    assert _one(spark, X.strip_domain("x"), x=text) == want


def test_names(spark):
    assert _one(spark, X.former_name("x"), x="New Co formerly Old Trading") == "Old Trading"
    assert _one(spark, X.former_name("x"), x="Osaka Foods") == "Foods"
    assert _one(spark, X.ocr(X.compact(X.norm_name("x"))), x="8uildcon-Textile Private Limited") == "buildcontextileprivatelimited"
    assert _one(spark, T.meaningful(X.norm_name("x")), x="Jarlan Bold LLC") == ["jarlan", "bold"]
    assert _one(spark, T.signature(T.meaningful(X.norm_name("x"))), x="Jarlan Bold LLC") == "bold_jarlan"
    assert _one(spark, T.structural("x"), x="dr shri acme of tools pvt ltd") == ["acme", "tools"]
    assert _one(spark, T.structural("x"), x="pvt ltd") == []


@pytest.mark.parametrize(("text", "want"), [("श्री एग्रो", "devanagari"), ("தமிழ்", "indic_other"), ("abc", "latin"), ("", "none"), ("123", "other"), ("مرحبا abc", "arabic")])
def test_script(spark, text, want):
    assert _one(spark, X.script_of("x"), x=text) == want


def test_sets(spark):
    assert _one(spark, T.trigrams("x"), x="ab") == ["ab"]
    assert _one(spark, T.trigrams("x"), x="") == []
    assert _one(spark, T.trigrams("x"), x="aaaa") == ["aaa"]
    assert _one(spark, T.jaccard(T.words("x"), T.words("y")), x="a b", y="b c") == pytest.approx(1 / 3)
    assert _one(spark, T.containment(T.words("x"), T.words("y")), x="a b", y="b") == 1.0
    assert _one(spark, T.common_prefix("x", "y"), x="abcd", y="abxd") == 2
    assert _one(spark, T.common_prefix("x", "y"), x="", y="abxd") == 0
    assert _one(spark, T.bounded_levenshtein("x", "y", 2), x="abcdef", y="uvwxyz") == 3
    assert _one(spark, T.text_similarity("x", "y"), x="Abc", y="aBC") == 1.0
    assert _one(spark, T.parse_ids("x"), x="['S2-1', S3-2, ,]") == ["S2-1", "S3-2"]


# One S1 name against candidates: edit similarity of names, word Jaccard, compact similarity (published to three places).
GOLDEN = [
    ("COMMON CONSULTANTS CENTER", 0.840, 0.500, 0.826),
    ("Mr Common Consultants Center", 0.750, 0.500, 0.760),
    ("Common Consultants Ctrsi", 0.875, 0.500, 0.864),
    ("Common  Consultants Care Corporation", 0.657, 1.000, 0.656),
    ("Common Limited Consultants", 0.500, 0.667, 0.542),
]


@pytest.mark.parametrize(("other", "edit", "words", "alnum"), GOLDEN)
def test_published_similarities(spark, other, edit, words, alnum):
    x, y = X.norm_name("x"), X.norm_name("y")
    row = spark.createDataFrame([("Common Consultants Care", other)], "x string, y string").select(
        T.edit_similarity(x, y, 12, 0.5).alias("edit"), T.jaccard(T.structural(x), T.structural(y)).alias("words"), T.edit_similarity(X.compact(x), X.compact(y), 10, 0.4).alias("alnum")
    ).first()
    assert row.edit == pytest.approx(edit, abs=6e-4)
    assert row.words == pytest.approx(words, abs=6e-4)
    assert row.alnum == pytest.approx(alnum, abs=6e-4)


def test_coordinates_and_category(spark):
    at = _one(spark, X.coordinates("x", F.lit("India")), x="12 MG Road, Mumbai")
    assert (at.lat, at.lng) == (19.0760, 72.8777)
    assert _one(spark, X.category("x", F.lit("")), x="Royal Tea Stall") == "food_dining"
    assert _one(spark, X.category("x", F.lit("")), x="Acme") == "commercial_services"
    assert _one(spark, X.human_size(F.length("x")), x="abc") == "3.00 B"
