"""Components against all pairs by brute force: chains, stars of near copies, short and empty texts."""

import random

import pytest

from kinloom.llm import jaccard_join as J
from kinloom.operators.components import components
from kinloom.llm.shingles import tokens


def _edit(r, words, n):
    words = list(words)
    for _ in range(n):
        words[r.randrange(len(words))] = r.choice(["x", "y", "zz", "q" + str(r.randint(0, 9))])
    return words


def _texts(seed):
    r = random.Random(seed)
    word = lambda: "".join(r.choices("abcdefgh", k=2))
    out = [None, "", " \n", "a", "a", "A", "a b", "A b", "a b c", "a\tb\x0bC", "b a"]
    for _ in range(6):  # stars around a text
        base = [word() for _ in range(r.choice([12, 40, 200, 700]))]
        for _ in range(r.choice([2, 9, 40])):
            out.append(" ".join(_edit(r, base, r.choice([0, 1, 2, 3, 6, len(base) // 20]))))
    chain = [word() for _ in range(300)]  # each near the one before, the ends far apart
    for _ in range(25):
        chain = _edit(r, chain, 3)
        out.append(" ".join(chain))
    shared = " ".join(word() for _ in range(60))
    out += [" ".join(word() for _ in range(r.randint(1, 30))) + "\n" + shared for _ in range(40)]
    out += [" ".join(word() for _ in range(20_000))] * 2
    r.shuffle(out)
    return out


def _brute(texts, size=J.WORDS, percent=J.PERCENT):
    own = [set(tokens(t, size).tolist()) for t in texts]
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, x in enumerate(own):
        for j in range(i):
            n = len(x & own[j])
            if n and 100 * n >= percent * (len(x) + len(own[j]) - n):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return {i: (len(own[i]), find(i)) for i in range(len(texts))}


@pytest.mark.parametrize(("seed", "group", "words", "percent"), [(1, 128, 3, 90), (2, 4, 3, 90), (3, 8, 5, 80), (4, 128, 5, 80)])
def test_against_all_pairs(spark, seed, group, words, percent):
    texts = _texts(seed)
    docs = spark.createDataFrame([(i, t, "p", 5) for i, t in enumerate(texts)], "doc_id long, text string, part string, n int")
    got = J.join(docs.repartition(3), words, percent, group).collect()
    assert len(got) == len(texts)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == _brute(texts, words, percent)


def test_repeated_rows_and_ids(spark):
    long = "w1 w2 w3 w4 w5 w6 w7"
    rows = [(1, long), (1, long), (2, long), (3, "other text here"), (2, "other text here"), (None, long), (None, "lonely words here"), (9, "")]
    got = sorted(J.join(spark.createDataFrame(rows, "doc_id long, text string")).collect(), key=str)
    assert len(got) == len(rows)
    assert {r.doc_id: r.component_id for r in got if r.doc_id} == {1: 1, 2: 1, 3: 1, 9: 9}
    assert {r.component_id for r in got if r.doc_id is None} == {1, None}
    assert J.join(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_parts_never_miss_a_link():
    """Sets at the very edge of the similarity share a part."""
    import numpy as np

    r = np.random.default_rng(3)
    for i in range(800):
        percent = (80, 90)[i % 2]
        n = int(r.integers(1, 900))
        extra = int(r.integers(0, J.most_different(n, percent) + 1))
        pool = r.integers(0, 2**63, n + extra, dtype=np.uint64)
        a = np.unique(pool[:n])
        gone = int(r.integers(0, extra + 1)) if n > extra else 0
        b = np.unique(np.concatenate([a[gone:], pool[n : n + extra - gone]]))
        if J.linked(a, b, percent):
            (x, need), (y, more) = J.parts(a, percent), J.parts(b, percent)
            assert np.intersect1d(x, y).size >= max(need, more)


def test_components_of_a_path(spark):
    ids = list(range(200))
    random.Random(1).shuffle(ids)
    links = spark.createDataFrame([*zip(ids, ids[1:], strict=False), (500, 501), (7, 7)], "x long, y long")
    got = {r.id: r.component for r in components(links).collect()}
    assert got == {i: 0 for i in range(200)} | {500: 500, 501: 500}
    assert components(links.limit(0)).count() == 0
