"""Packing: every token once, gapless sequences, little padding, whatever the lengths."""

import random
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from kinloom.llm import packing
from kinloom.llm.bpe import default_vocabulary


def _pack(lengths, capacity, buffer):
    p, out = packing.Packer(capacity, buffer), []
    for i, n in enumerate(lengths):
        out += p.add(i, n)
    return out + list(p.pack(last=True))


def _holds(lengths, pieces, capacity):
    by_doc, by_seq = {}, {}
    for d, s, n, q, o in pieces:
        assert n > 0
        by_doc.setdefault(d, []).append((s, n))
        by_seq.setdefault(q, []).append((o, n))
    assert set(by_doc) == {i for i, n in enumerate(lengths) if n}
    for d, parts in by_doc.items():
        at = 0
        for s, n in sorted(parts):
            assert s == at
            at += n
        assert at == lengths[d]
    for parts in by_seq.values():
        at = 0
        for o, n in sorted(parts):
            assert o == at
            at += n
        assert at <= capacity
    padded = sum(capacity - sum(n for _, n in parts) for parts in by_seq.values())
    assert padded < capacity
    return by_seq


@pytest.mark.parametrize("seed", range(30))
def test_pieces_cover_all(seed):
    r = random.Random(seed)
    capacity = r.choice([1, 2, 7, 64])
    lengths = [r.choice([0, 1, 2, capacity, capacity + 1, r.randint(0, 300)]) for _ in range(r.choice([0, 1, 5, 200]))]
    _holds(lengths, _pack(lengths, capacity, r.choice([1, 50, 10_000])), capacity)


def test_costs_are_balanced():
    r = random.Random(3)
    lengths = [r.randint(1, 200) for _ in range(4000)]
    by_seq = _holds(lengths, _pack(lengths, 1024, 1 << 30), 1024)
    costs = [sum(packing.cost(n) for _, n in x) for x in by_seq.values()]
    assert max(costs) < 1.25 * np.mean(costs)


def _slowly(lengths, capacity):
    """The rule for one buffer, step by step: whole sequences, then descending into the cheapest with room, then cuts."""
    out, sequences = [], []
    for doc, n in enumerate(lengths):
        for start in range(0, n - n % capacity, capacity):
            sequences.append([(doc, start, capacity)])
    whole = len(sequences)
    tails = sorted(((doc, n - n % capacity, n % capacity) for doc, n in enumerate(lengths) if n % capacity), key=lambda x: -x[2])
    sequences += [[] for _ in range(-(-sum(x[2] for x in tails) // capacity))]
    full = lambda s: sum(x[2] for x in s)
    late = []
    for piece in tails:
        fit = [s for s in sequences[whole:] if full(s) + piece[2] <= capacity]
        if fit:
            min(fit, key=lambda s: sum(packing.LINEAR * x[2] + packing.QUADRATIC * x[2] ** 2 for x in s)).append(piece)
        else:
            late.append(piece)
    rooms = sorted(sequences[whole:], key=full)
    for doc, start, n in late:
        while n:
            s = next(s for s in rooms if full(s) < capacity)
            m = min(n, capacity - full(s))
            s.append((doc, start, m))
            start, n = start + m, n - m
    for q, s in enumerate(sequences):
        at = 0
        for doc, start, n in s:
            out.append((doc, start, n, q, at))
            at += n
    return sorted(out)


@pytest.mark.parametrize("seed", range(20))
def test_against_the_rule_step_by_step(seed):
    r = random.Random(seed)
    lengths = [r.choice([0, r.randint(1, 64), r.randint(1, 300)]) for _ in range(r.choice([1, 5, 120]))]
    assert sorted(_pack(lengths, 64, 1 << 30)) == _slowly(lengths, 64)


def test_waiting_pieces_hold_their_tails_only():
    import tracemalloc

    packer = packing.Packer()
    tracemalloc.start()
    for i in range(300):
        held = packing.Held(i, np.arange(200_300, dtype="<u4"))
        for _ in packer.add(held, held.total):
            pass
        held.keep_tail(packer.capacity)
    assert tracemalloc.get_traced_memory()[0] < 4_000_000
    tracemalloc.stop()
    last = [d.row(s, n, q, o) for d, s, n, q, o in packer.pack(last=True)]
    whole = np.arange(200_300, dtype="<u4")
    assert all(r[3] == zlib.crc32(whole[r[1] : r[1] + r[2]].tobytes()) and r[4] == 200_300 for r in last)
    assert sum(r[2] for r in last) == 300 * (200_300 % packer.capacity)


def test_the_registered_query(spark, tmp_path):
    rows = [(i, t) for i, t in enumerate(["a b c", None, "", "word " * 3000])]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = packing.op6(spark, str(tmp_path)).collect()
    t = Tokenizer.from_file(default_vocabulary())
    assert {r.doc_id: r.doc_tokens for r in got} == {i: len(t.encode(x or "", add_special_tokens=False).ids) + 1 for i, x in rows}


def test_against_tokenizers(spark):
    texts = ["a b c", None, "", "word " * 3000, "x" * 5000, "a b c", "<|endoftext|>é日"]
    df = spark.createDataFrame([(i, t, i, "z") for i, t in enumerate(texts)], "doc_id long, text string, length int, offset string")
    rows = packing.pack(df.repartition(2), default_vocabulary()).collect()
    t = Tokenizer.from_file(default_vocabulary())
    ids = [[*t.encode(x or "", add_special_tokens=False).ids, 0] for x in texts]
    pieces = [(r.doc_id, r.start, r.length, r.sequence_id, r.offset) for r in rows]
    for r in rows:
        assert r.doc_tokens == len(ids[r.doc_id])
        assert r.ids_crc32 == zlib.crc32(np.array(ids[r.doc_id][r.start : r.start + r.length], "<u4").tobytes())
    got = {}
    for d, s, n, _, _ in pieces:
        got.setdefault(d, []).append((s, n))
    assert {d: sum(n for _, n in x) for d, x in got.items()} == {i: len(x) for i, x in enumerate(ids)}


def test_empty_table(spark):
    assert packing.pack(spark.createDataFrame([], "doc_id long, text string"), default_vocabulary()).count() == 0
