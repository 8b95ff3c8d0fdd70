"""The multiplied-out scores against kernels taken one by one, held-out accuracy, and edge cases."""

import binascii
import random

import numpy as np

from kinloom.llm import language as L


def _docs(n=400, seed=1):
    r = random.Random(seed)
    syllables = {"en": "the ing tion and er wh", "de": "sch ung ein keit ß ü", "es": "ción ado ll ñ que os"}
    rows = []
    for i in range(n):
        lang = r.choice(list(syllables))
        words = ["".join(r.choices(syllables[lang].split(), k=r.randint(1, 3))) for _ in range(r.randint(3, 60))]
        rows.append((i, " ".join(words), lang))
    return rows


def test_scores_equal_kernels_one_by_one():
    rows = _docs(90)
    spectra, labels = [L.spectrum(t) for _, t, _ in rows], [x for _, _, x in rows]
    model = L.fit(spectra, labels, landmarks=12, ridge=1e-3)
    kernel = lambda a, b: len(np.intersect1d(a, b)) / np.sqrt(len(a) * len(b))
    marks = [s for lang in sorted(set(labels)) for s in [x for x, y in zip(spectra, labels, strict=True) if y == lang][:4]]
    k_mm = np.array([[kernel(a, b) for b in marks] for a in marks])
    values, vectors = np.linalg.eigh(k_mm)
    good = values > 1e-6 * values[-1]
    root = vectors[:, good] / np.sqrt(values[good])
    phi = np.array([[kernel(a, b) for b in marks] for a in spectra]) @ root
    weight = np.array([1 / labels.count(x) for x in labels]) / 3
    for c, lang in enumerate(model.languages):
        y = np.where(np.array(labels) == lang, 1.0, -1.0)
        mean, level = weight @ phi, weight @ y
        w = np.linalg.solve((phi - mean).T @ ((phi - mean) * weight[:, None]) + 1e-3 * np.eye(phi.shape[1]), (phi - mean).T @ (weight * (y - level)))
        assert np.allclose((phi - mean) @ w + level, model.decide(spectra)[:, c], atol=1e-3)


def test_spectrum():
    assert len(L.spectrum("ab")) == len({" ", "a", "b", " a", "ab", "b ", " ab", "ab "})
    assert np.array_equal(L.spectrum("A--b!1"), L.spectrum("a b"))
    assert len(L.spectrum(None)) == len(L.spectrum("")) == len(L.spectrum("12 ²³ !?")) == 0
    text = "".join(random.Random(2).choices("abcdé ", k=5000))
    texts = [text, "ab    cd" * 30, "x" + " " * 700 + "y\u0301z ΑΣ ΣΑΣ İi", "12 " * 400 + "a", " - " * 500, "αΣ" * 99]
    whole = [L.spectrum(t) for t in texts]
    try:
        for L.STRETCH in (1, 2, 3, 4, 5, 7, 64, 100, 101):
            assert all(np.array_equal(L.spectrum(t), w) for t, w in zip(texts, whole, strict=True)), L.STRETCH
    finally:
        L.STRETCH = 1 << 20


def test_sample_is_bounded_and_null_ids_train(spark):
    docs = spark.createDataFrame([(None if i % 2 else i, t, lang) for i, t, lang in _docs(200)], "doc_id long, text string, lang string")
    assert {r.h for r in docs.filter("doc_id IS NULL").select(L.held_out().alias("h")).collect()} == {False}
    full, less = L.train(docs), L.train(docs, ngrams=3 * 400)
    assert full.languages == less.languages and len(less.ngrams) <= 3 * 400 < len(L.train(docs, ngrams=1 << 30).ngrams) + 1200


def test_identify(spark):
    rows = _docs() + [(1000, None, "en"), (1001, "", "en"), (1002, "123 !!", None), (1003, "the ing " * 30_000, None), (1, "the ing tion", None)]
    docs = spark.createDataFrame([(*r, "s", 0.5) for r in rows], "doc_id long, text string, lang string, lang_pred string, score double")
    found = L.identify(docs, L.train(docs)).collect()
    assert len(found) == len(rows)
    by = {r.doc_id: r for r in found if r.doc_id >= 1000}
    assert all((by[i].lang_pred, by[i].score) == ("und", 0.0) for i in (1000, 1001, 1002))
    assert by[1003].lang_pred == "en"
    tested = [r for r in found if r.lang and r.doc_id < 1000 and binascii.crc32(str(r.doc_id).encode()) % 3 == 1]
    assert np.mean([r.lang == r.lang_pred for r in tested]) > 0.97
    assert all(0 <= r.score <= 1 for r in found)


def test_held_out_rows_teach_nothing(spark):
    out = [i for i in range(50) if binascii.crc32(str(i).encode()) % 3 == 1]
    docs = spark.createDataFrame([(i, "word", "xx") for i in out] + [(60, None, "en"), (61, "a", None)], "doc_id long, text string, lang string")
    model = L.train(docs)
    assert model.languages == []
    assert {r.lang_pred for r in L.identify(docs, model).collect()} == {"und"}
    assert L.identify(docs.limit(0), model).count() == 0
