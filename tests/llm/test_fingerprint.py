"""Signatures against the same formulas in Python, the next document's text, and the collision rate."""

import collections
import hashlib
import random
import re

import numpy as np

from kinloom.llm import fingerprint as P

LETTERS = "abcdefghij"


def _docs():
    r = random.Random(4)
    rows = [(i * 7 - 100, " ".join("".join(r.choices(LETTERS, k=2)) for _ in range(r.choice([0, 1, 5, 80, 400])))) for i in range(60)]
    return [*rows, (2000, None), (2001, ""), (2002, "  \n "), (2003, "Same texté here"), (2003, "Same texté here"), (2004, "same TEXTÉ HERE"), (2005, "w " * 60_000), (None, "no id")]


def _terms(text):
    return collections.Counter(w for w in re.split(r"[ \t-\r]+", text.lower()) if w)


def _jaccard(a, b):
    top = sum(max(a[k], b[k]) for k in {*a, *b})
    return sum(min(a[k], b[k]) for k in {*a, *b}) / top if top else 1.0


def test_next_text_and_digests(spark):
    rows = sorted(((d is not None, d or 0, t or "") for d, t in _docs()))
    texts = [t for _, _, t in rows]
    docs = spark.createDataFrame([(d, t, "b", 9) for d, t in _docs()], "doc_id long, text string, bucket string, rid int")
    for chars in (50, 1 << 20):
        got = P.fingerprints(docs.repartition(3), range_chars=chars).collect()
        want = []
        for i, (some, d, t) in enumerate(rows):
            q = len(t) // 4
            edited = t[: len(t) - q] + texts[(i + 1) % len(texts)][:q]
            want.append((d if some else None, len(t), hashlib.sha256(edited.encode()).hexdigest()))
        key = lambda x: (x[0] is not None, x)
        assert sorted(((r.doc_id, r.n_chars, r.edited_sha256) for r in got), key=key) == sorted(want, key=key)
        by = {r.doc_id: r for r in got}
        assert by[2000].fingerprint == by[2001].fingerprint == by[2002].fingerprint == ""
        assert by[2000].near_next == 1.0
        assert by[2003].fingerprint == by[2004].fingerprint != ""
        assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in got)


def test_least_values_against_python(spark):
    """Each sample's term and quantised weight, found by a loop, is where two texts agree or not."""
    texts = ["a b b c", "a b c c d", "a a a a b", "x y"]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    draws = {}
    words = spark.createDataFrame([(w,) for w in sorted({w for t in texts for w in t.split()})], "w string").selectExpr("w", "xxhash64(w) AS term")
    for n in (1, 2, 3, 4):
        for i in range(P.SAMPLES):
            for r in words.selectExpr("w", f"{P.sample_sql(i, 'term', f'ln({n}D)')} AS a").collect() if i < 4 else []:
                draws[i, r.w, n] = r.a
    sig = {r.id: r.sig0 for r in P.signatures(df, ["id"], ["text"]).collect()}
    for i in range(4):
        best = [min(draws[i, w, n] for w, n in _terms(t).items()) for t in texts]
        for x in range(4):
            for y in range(4):
                assert (best[x] == best[y]) == (sig[x][i] == sig[y][i])


def test_collision_rate_is_generalised_jaccard(spark):
    r = random.Random(8)
    pairs = []
    for i in range(40):
        a = r.choices(LETTERS, k=200)
        b = a[: r.randint(0, 200)] + r.choices("klmnopq" + LETTERS, k=100)
        pairs.append((i, " ".join(a), " ".join(b)))
    df = spark.createDataFrame(pairs, "id long, a string, b string")
    got = {x.id: np.mean(np.array(x.sig0) == np.array(x.sig1)) for x in P.signatures(df, ["id"], ["a", "b"], samples=96).collect()}
    error = [got[i] - _jaccard(_terms(a), _terms(b)) for i, a, b in pairs]
    assert abs(np.mean(error)) < 0.08
    assert np.std(error) < 0.1


def test_one_and_none(spark):
    one = P.fingerprints(spark.createDataFrame([(5, "abcd efgh")], "doc_id long, text string")).collect()
    assert [(r.near_edited, r.near_next) for r in one][0][1] == 1.0
    assert P.fingerprints(spark.createDataFrame([], "doc_id long, text string")).count() == 0
