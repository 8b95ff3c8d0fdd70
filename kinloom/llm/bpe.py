"""Byte-level BPE encoding and decoding, exact on texts of any length.

A text is cut, where it can be, between a non-space and a space: no pre-token crosses such a place, so
the parts are encoded by themselves. A long unsplit stretch has no such place. Its long pre-tokens are
encoded by tree concatenation: halves are encoded by themselves (on ``threads`` threads), and at each
join a window of tokens is encoded anew; it grows until its first token is the left side's and its last
token the right side's. A token sequence is the BPE encoding of its bytes if and only if each
neighbouring pair is, so that agreement makes the concatenation exact.

Defined results: a null text counts as empty and has no ids; the strings of added tokens in a text are
those tokens; repeated rows are encoded one by one; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinloom.llm.store import small_batches

# The pre-token pattern of the byte-level vocabulary, as its file's pre-tokenizer names it.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

MAX_VOCABULARY_BYTES = 64 << 20
#: Characters that are encoded in one call; longer texts are cut.
STRETCH = 1 << 16
#: Bytes of a pre-token up to which it is encoded in one call; longer ones form a tree.
LEAF = 1 << 11
#: Tokens on either side of a join in the first window.
WINDOW = 8

_SAFE = re.compile(r"(?<=[^\s])(?=[ \n])")


def read_vocabulary(path: str) -> bytes:
    """The tokenizer's file, read on the driver; it is broadcast, and so its size is checked."""
    with open(path, "rb") as f:
        data = f.read(MAX_VOCABULARY_BYTES + 1)
    if len(data) > MAX_VOCABULARY_BYTES:
        raise ValueError(f"{path}: a vocabulary file over {MAX_VOCABULARY_BYTES} bytes isn't broadcast")
    return data


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _byte_of_char() -> dict[str, int]:
    """The printable stand-in of each byte: itself if it is a visible Latin-1 character, else the next code from 256."""
    visible = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    hidden = [b for b in range(256) if b not in set(visible)]
    return {chr(b): b for b in visible} | {chr(256 + i): b for i, b in enumerate(hidden)}


def tree_concatenate(data: bytes, encode, token_bytes, leaf: int = LEAF, window: int = WINDOW, run=map) -> list[int]:
    """BPE ids of one long pre-token. ``run`` maps ``encode`` over the leaves, in parallel if it can."""
    if len(data) <= leaf:
        return encode(data)
    n = 1 << (-(-len(data) // leaf) - 1).bit_length()  # leaves of a balanced tree
    edges = [len(data) * i // n for i in range(n + 1)]
    level = list(run(encode, [data[a:b] for a, b in zip(edges, edges[1:], strict=False)]))
    while len(level) > 1:
        level = [_join(a, b, encode, token_bytes, window) for a, b in zip(level[::2], level[1::2], strict=True)]
    return level[0]


def _join(left: list[int], right: list[int], encode, token_bytes, k: int) -> list[int]:
    if not left or not right:
        return left or right
    while True:
        a, b = left[-k:], right[:k]
        new = encode(b"".join(map(token_bytes.__getitem__, a)) + b"".join(map(token_bytes.__getitem__, b)))
        if (k >= len(left) or new[0] == a[0]) and (k >= len(right) or new[-1] == b[-1]):
            return left[:-k] + new + right[k:]
        k *= 2


class Codec:
    """Encodes and decodes with the vocabulary of a byte-level BPE file of the tokenizers library."""

    def __init__(self, data: bytes, threads: int = 1) -> None:
        import regex
        import tiktoken

        spec = json.loads(data)
        model, pre = spec["model"], spec["pre_tokenizer"]
        plain = model["type"] == "BPE" and pre["type"] == "ByteLevel" and pre["use_regex"] and not pre["add_prefix_space"] and not spec["normalizer"]
        if not plain or any(t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"] for t in spec["added_tokens"]):
            raise ValueError("only a plain byte-level BPE file is supported")
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        byte = _byte_of_char()
        ranks = {bytes(byte[c] for c in token): i for token, i in model["vocab"].items() if token not in self.special}
        merged = [model["vocab"]["".join(m if isinstance(m, list) else m.split(" "))] for m in model["merges"]]
        if merged != sorted(merged):
            raise ValueError("the vocabulary's ids don't follow the order of its merges")
        self.token_bytes = {i: b for b, i in ranks.items()} | {i: s.encode() for s, i in self.special.items()}
        self._bpe = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self._pieces = regex.compile(PATTERN)
        self._cut = re.compile("|".join(map(re.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None
        self._threads = threads

    def _piece(self, data: bytes) -> list[int]:
        return self._bpe._encode_single_piece(data) if data else []

    def _unsplit(self, text: str) -> list[int]:
        out: list[int] = []
        for m in self._pieces.finditer(text):
            piece = m[0].encode()
            if len(piece) <= LEAF:
                out += self._piece(piece)
            elif self._threads > 1:
                with ThreadPoolExecutor(self._threads) as pool:
                    out += tree_concatenate(piece, self._piece, self.token_bytes, run=pool.map)
            else:
                out += tree_concatenate(piece, self._piece, self.token_bytes)
        return out

    def _plain(self, text: str) -> list[int]:
        if len(text) <= STRETCH:
            return self._bpe.encode_ordinary(text)
        out: list[int] = []
        start = 0
        while start < len(text):
            end = len(text)
            if end - start > STRETCH:
                m = _SAFE.search(text, start + STRETCH // 2)
                end = m.start() if m else end
            part = text[start:end]
            out += self._bpe.encode_ordinary(part) if len(part) <= STRETCH else self._unsplit(part)
            start = end
        return out

    def encode(self, text: str | None) -> list[int]:
        if not text:
            return []
        if self._cut is None or not self._cut.search(text):
            return self._plain(text)
        out, at = [], 0
        for m in self._cut.finditer(text):
            out += [*self._plain(text[at : m.start()]), self.special[m[0]]]
            at = m.end()
        return out + self._plain(text[at:])

    def decode(self, ids: list[int]) -> str:
        return b"".join(map(self.token_bytes.__getitem__, ids)).decode("utf-8", "replace")


_CODECS: dict[bytes, Codec] = {}


def codec(data: bytes, threads: int = 1) -> Codec:
    """One per Python worker and vocabulary."""
    key = hashlib.sha256(data).digest() + bytes([threads])
    if key not in _CODECS:
        _CODECS[key] = Codec(data, threads)
    return _CODECS[key]


def encode_column(df: DataFrame, path: str, text: str = "text", out: str = "ids", threads: int = 1) -> DataFrame:
    """``df`` with the ids of ``text`` as an array; a pass over the rows, no shuffle."""
    small_batches(df.sparkSession)
    shared = df.sparkSession.sparkContext.broadcast(read_vocabulary(path))

    @F.pandas_udf("array<int>")
    def ids(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        own = codec(shared.value, threads)
        for batch in batches:
            yield batch.map(own.encode)

    return df.withColumn(out, ids(F.col(text)))


def decode_column(df: DataFrame, path: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """``df`` with the text of an array of ids."""
    small_batches(df.sparkSession)
    shared = df.sparkSession.sparkContext.broadcast(read_vocabulary(path))

    @F.pandas_udf("string")
    def texts(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        own = codec(shared.value)
        for batch in batches:
            yield batch.map(lambda x: own.decode(list(x)) if x is not None else "")

    return df.withColumn(out, texts(F.col(ids)))


def digests(docs: DataFrame, path: str, threads: int = 1) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256``: encoded and decoded in the worker, where only digests leave it."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(read_vocabulary(path))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = codec(shared.value, threads)
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        for batch in batches:
            rows = []
            for text in batch["text"]:
                ids = own.encode(text)
                rows.append((len(ids), sha(",".join(map(str, ids))), sha(own.decode(ids))))
            out = pd.DataFrame(rows, columns=["n_tokens", "ids_sha256", "decoded_sha256"], index=batch.index)
            yield pd.concat([batch[["doc_id"]], out], axis=1)

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInPandas(run, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op2(spark, sf_dir: str) -> DataFrame:
    from kinloom.llm.tables import table

    return digests(table(spark, sf_dir, "documents"), default_vocabulary())
