"""Encoding against the tokenizers library, tree concatenation against one call, and the round trip."""

import hashlib
import random

from tokenizers import Tokenizer

from kinloom.llm import bpe

PATH = bpe.default_vocabulary()
CODEC = bpe.Codec(bpe.read_vocabulary(PATH))
THEIRS = Tokenizer.from_file(PATH)
ALPHABETS = ["abcdefghijklmnopqrstuvwxyz", "ab", "a", "ther", "éèàü", "日本語中文字", "0123456789", "!?.*#", "  \n\t", "aé日1!  　'sréll"]


def _theirs(text):
    return THEIRS.encode(text, add_special_tokens=False).ids


def test_tree_equals_one_call():
    r = random.Random(5)
    for _ in range(150):
        data = "".join(r.choices(r.choice(ALPHABETS[:8]), k=r.randint(1, 400))).encode()
        whole = CODEC._piece(data)
        for leaf in (1, 3, 16):
            assert bpe.tree_concatenate(data, CODEC._piece, CODEC.token_bytes, leaf=leaf, window=1) == whole


def test_against_tokenizers():
    r = random.Random(6)
    for _ in range(300):
        text = "".join(r.choice(r.choice(ALPHABETS)) for _ in range(r.randint(0, 80)))
        assert CODEC.encode(text) == _theirs(text)
    for text in ["", "<|endoftext|>", "a<|endoftext|><|endoftext|> b", "<|endof", "\x00\x1c a"]:
        assert CODEC.encode(text) == _theirs(text)


def test_long_texts():
    r = random.Random(7)
    shared = bpe.Codec(bpe.read_vocabulary(PATH), threads=4)
    for text in ["a" * 90_000, "日本" * 40_000, "x<|endoftext|>" * 6000, "word " * 30_000, " " * 70_000 + "x", "".join(r.choices("abc1!", k=100_000)), "　日" * 40_000]:
        ids = CODEC.encode(text)
        assert ids == _theirs(text) == shared.encode(text)
        assert CODEC.decode(ids) == text


def test_every_code_point_splits_alike():
    for low in range(0, 0x110000, 8192):
        text = "".join(f"a{chr(x)}1 {chr(x)}! {chr(x)}" for x in range(low, low + 8192) if not 0xD800 <= x < 0xE000)
        if text:
            assert CODEC.encode(text) == _theirs(text)


def test_columns_and_digests(spark):
    texts = ["Hello there", None, "", "Hello there", "é" * 70_000]
    df = spark.createDataFrame([(i, t, "x", 3) for i, t in enumerate(texts)], "doc_id long, text string, ids string, n_tokens int")
    rows = {r.doc_id: r for r in bpe.digests(df, PATH).collect()}
    for i, t in enumerate(texts):
        ids = _theirs(t or "")
        assert rows[i].n_tokens == len(ids)
        assert rows[i].ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert rows[i].decoded_sha256 == hashlib.sha256((t or "").encode()).hexdigest()
    both = bpe.decode_column(bpe.encode_column(df, PATH), PATH)
    assert {r.doc_id: r.decoded for r in both.collect()} == {i: t or "" for i, t in enumerate(texts)}
    assert bpe.digests(df.limit(0), PATH).count() == 0
