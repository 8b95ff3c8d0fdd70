"""Registered queries without SQL, run over tables in folders, beside plain Python."""

import collections
import hashlib
import math
import re
import zlib

import pytest
import xxhash
from tokenizers import Tokenizer

from kinloom.llm import bpe, fingerprint, language, secret_scan
from kinloom.llm.bpe import default_vocabulary

SF = "/root/testdata/sf0.001"
TEXTS = [
    "the quick brown fox jumps over the lazy dog " * 3,
    "The quick brown fox, jumps over the lazy cat " * 4,
    "",
    None,
    " \n\t ",
    "Größe und Maß 日本語 " * 50,
    "same words same words",
    "same words same words",
    "x" * 70_000,
    "api_key = 'Zq8Wm2Lr7TvX4bNc9KdY' and again api_key = 'Zq8Wm2Lr7TvX4bNc9KdY'",
]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Documents with ties in text, nulls, a long text, and extra columns named like the queries' own."""
    path = tmp_path_factory.mktemp("tables")
    rows = [(7 * i + 3, t, "zz", 1, "own") for i, t in enumerate(TEXTS)]
    spark.createDataFrame(rows, "doc_id long, text string, fingerprint string, n_chars int, findings string").repartition(3).write.parquet(f"{path}/documents.parquet")
    return str(path)


def _hash(data: bytes, seed: int) -> int:
    return xxhash.xxh64(data, seed=seed).intdigest()


def _int64(x: int) -> bytes:
    return x.to_bytes(8, "little")


def _sample(word: str, n: int, i: int) -> tuple[float, int]:
    """The least value's rank and the quantised weight of a word that occurs n times, from the method's formulas."""
    own = _hash(_int64(_hash(word.encode(), 42)), 42)
    g, h = (_hash((2 * i + k).to_bytes(4, "little"), own) for k in (0, 1))
    part = lambda x, shift: ((x >> shift & (2**25 - 1)) + 0.5) / 2**25
    r, c = (-math.log(part(x, 0) * part(x, 25)) for x in (g, h))
    b = ((g >> 50) * 2**14 + (h >> 50)) / 2**28
    t = math.floor(math.log(n) / r + b)
    return math.log(c) - r * (t - b) - r, t


def _samples(text: str) -> list[tuple[str, int]]:
    words = collections.Counter(w for w in re.split(r"[ \t-\r]+", text.lower()) if w)
    out = []
    for i in range(fingerprint.SAMPLES if words else 0):
        drawn = {w: _sample(w, n, i) for w, n in words.items()}
        least = min(drawn, key=lambda w: drawn[w][0])
        out.append((least, drawn[least][1]))
    return out


def _near(a: list, b: list) -> float:
    return 1.0 if not a and not b else 0.0 if not a or not b else sum(x == y for x, y in zip(a, b, strict=True)) / len(a)


def test_op9(spark, folder):
    got = {r.doc_id: r for r in fingerprint.op9(spark, folder).collect()}
    texts = [t or "" for t in TEXTS]
    assert len(got) == len(texts)
    for i, text in enumerate(texts):
        r, cut = got[7 * i + 3], len(text) // 4
        edited = text[: len(text) - cut] + texts[(i + 1) % len(texts)][:cut]
        assert (r.n_chars, r.edited_sha256) == (len(text), hashlib.sha256(edited.encode()).hexdigest())
        own = _samples(text)
        assert r.near_edited == pytest.approx(_near(own, _samples(edited)))
        assert r.near_next == pytest.approx(_near(own, _samples(texts[(i + 1) % len(texts)])))
    assert got[45].fingerprint == got[52].fingerprint != got[3].fingerprint


def test_op2(spark, folder):
    tokenizer = Tokenizer.from_file(default_vocabulary())
    tokenizer.no_truncation()
    tokenizer.no_padding()
    got = {r.doc_id: r for r in bpe.op2(spark, folder).collect()}
    for i, text in enumerate(TEXTS):
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        want = (len(ids), sha(",".join(map(str, ids))), sha(tokenizer.decode(ids, skip_special_tokens=False)))
        assert (got[7 * i + 3].n_tokens, got[7 * i + 3].ids_sha256, got[7 * i + 3].decoded_sha256) == want


def test_op7(spark, folder):
    texts = {7 * i + 3: t for i, t in enumerate(TEXTS)}
    found = secret_scan.op7(spark, folder).collect()
    for r in found:
        assert hashlib.sha256(texts[r.doc_id][r.start : r.start + r.length].encode()).hexdigest() == r.value_sha256
    value = "Zq8Wm2Lr7TvX4bNc9KdY"
    places = [m.start() for m in re.finditer(value, TEXTS[9])]
    assert sorted((r.doc_id, r.start, r.length) for r in found) == [(66, p, len(value)) for p in places]


def test_op1(spark):
    docs = {r.doc_id: r for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = language.op1(spark, SF).collect()
    assert sorted(r.doc_id for r in got) == sorted(docs)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1 for r in got)
    assert all((r.lang_pred == language.UNDETERMINED) == (not any(c.isalpha() for c in docs[r.doc_id].text or "")) for r in got)
    tested = [r for r in got if r.held_out and docs[r.doc_id].lang]
    assert sum(r.lang_pred == docs[r.doc_id].lang for r in tested) >= 0.9 * len(tested) > 0
