"""Cost-balanced packing of tokenised documents into sequences of at most ``capacity`` tokens.

A document's tokens (its ids and an end id) cost ``LINEAR * n + QUADRATIC * n * n`` as attention over
one piece of n tokens. Whole pieces of ``capacity`` tokens fill sequences of their own, as they would
coming first in descending order. The rest of each document joins a buffer; a full buffer is packed:
in descending order, each piece goes to the sequence of lowest cost that has room for it. What fits
nowhere whole is cut over the largest rooms left, so every sequence of the buffer is filled, and what
remains (less than a sequence and a piece) starts the next buffer. Only the last sequence of a
partition is padded.

Each Spark partition packs its own rows, so there is no shuffle and memory is bounded by the buffer
and one document: of what waits, only the tail's tokens are held, a sequence at most. Sequence ids carry the partition's number; a task that runs again reads the same
rows in the same order and gives the same ids.

Defined results: a null text counts as empty and gives one piece, its end id; repeated rows are packed
each; an empty table gives no rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame

from kinloom.llm.bpe import codec, default_vocabulary, read_vocabulary
from kinloom.llm.store import small_batches

CAPACITY = 1024
END_ID = 0
LINEAR = 1.0
#: Against the linear part: attention over a piece of CAPACITY tokens costs as much again.
QUADRATIC = 1.0 / CAPACITY
#: A buffer is packed when it holds so many tokens.
BUFFER = 1 << 20


def cost(n):
    return LINEAR * n + QUADRATIC * n * n


class Packer:
    """Pieces are (document row, start, length); ``out`` gets (row, start, length, sequence, offset)."""

    def __init__(self, capacity: int = CAPACITY, buffer: int = BUFFER) -> None:
        self.capacity, self.buffer = capacity, buffer
        self.waiting: list[tuple[object, int, int]] = []
        self.tokens = 0
        self.sequences = 0

    def add(self, doc: object, n: int) -> Iterator[tuple[object, int, int, int, int]]:
        start = 0
        while n - start >= self.capacity:
            yield doc, start, self.capacity, self.sequences, 0
            self.sequences += 1
            start += self.capacity
        if start < n:
            self.waiting.append((doc, start, n - start))
            self.tokens += n - start
            if self.tokens >= self.buffer:
                yield from self.pack(last=False)

    def pack(self, last: bool) -> Iterator[tuple[object, int, int, int, int]]:
        n = -(-self.tokens // self.capacity) if last else self.tokens // self.capacity
        if not n:
            return
        pieces = sorted(self.waiting, key=lambda p: -p[2])
        self.waiting, self.tokens = [], 0
        room = np.full(n, self.capacity, dtype=np.int64)
        spent = np.zeros(n)
        left = []
        for doc, start, length in pieces:
            k = int(np.where(room >= length, spent, np.inf).argmin())
            if room[k] < length:
                left.append((doc, start, length))
                continue
            yield doc, start, length, self.sequences + k, int(self.capacity - room[k])
            room[k] -= length
            spent[k] += cost(length)
        order = iter(np.argsort(-room, kind="stable").tolist())
        k = next(order)
        for doc, start, length in left:
            while length:
                while not room[k] and (k := next(order, -1)) >= 0:
                    pass
                if k < 0:  # every sequence is full; the rest waits for the next buffer
                    self.waiting.append((doc, start, length))
                    self.tokens += length
                    break
                m = min(length, int(room[k]))
                yield doc, start, m, self.sequences + k, int(self.capacity - room[k])
                room[k] -= m
                start, length = start + m, length - m
            if k < 0:
                k = 0  # all rooms are 0 now, and order is used up
        self.sequences += n


class Held:
    """A document's tokens from ``first`` on, and how many it has in all."""

    __slots__ = ("doc_id", "first", "ids", "total")

    def __init__(self, doc_id: object, ids: np.ndarray) -> None:
        self.doc_id, self.ids, self.total, self.first = doc_id, ids, len(ids), 0

    def row(self, start: int, length: int, sequence: int, offset: int) -> tuple:
        own = self.ids[start - self.first : start - self.first + length]
        return self.doc_id, start, length, zlib.crc32(own.tobytes()), self.total, sequence, offset

    def keep_tail(self, capacity: int) -> None:
        """Whole sequences of tokens are written by now."""
        self.first = self.total - self.total % capacity
        self.ids = self.ids[self.first :].copy()


COLUMNS = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]


def pack(docs: DataFrame, path: str, capacity: int = CAPACITY, buffer: int = BUFFER) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(read_vocabulary(path))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own, packer = codec(shared.value), Packer(capacity, buffer)
        context = TaskContext.get()
        first = (context.partitionId() if context else 0) << 40

        def row(piece):
            held, start, length, sequence, offset = piece
            return held.row(start, length, first + sequence, offset)

        for batch in batches:
            found = []
            for doc_id, text in zip(batch["doc_id"], batch["text"], strict=True):
                held = Held(doc_id, np.array([*own.encode(text), END_ID], dtype="<u4"))
                found += map(row, packer.add(held, held.total))
                held.keep_tail(capacity)
            if found:
                yield pd.DataFrame(found, columns=COLUMNS)
        yield pd.DataFrame(list(map(row, packer.pack(last=True))), columns=COLUMNS)

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInPandas(run, f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")


def op6(spark, sf_dir: str) -> DataFrame:
    from kinloom.llm.tables import table

    return pack(table(spark, sf_dir, "documents"), default_vocabulary())
