r"""All links of documents whose shingle sets have a Jaccard similarity of ``percent`` / 100 or more, and their components.

Documents of equal sets form a class; one document of each stands for it. Two sets of that similarity
differ in at most H tokens, so of n > H parts of the tokens (dealt by hash, H by size class) at least
n - H are equal: representatives that share so many parts are candidates, however common single
shingles are. Parts that are empty in both need not tell them apart: n leaves room for a set's empty
parts, and only a set with more of them than that shares empty parts too. No part is capped.

Candidates are compared by a token-group matrix. A candidate's home is the document with which it shares
most parts, among the most central holders of its parts; the candidates of a home, cut into groups of about
``GROUP`` texts or ``GROUP_CHARS`` characters, are a group of similar documents. A group's token union is stored once, a query's overlap with the union
bounds its overlap with each member, and only where that reaches what a link needs is the group opened
and its members compared. This runs in two steps:

1. the members of a group are the queries of their own group, and what they link is contracted;
2. every candidate that still shares enough parts with other components meets all groups that hold them.

Step 2 makes the result exact; after step 1 nearly only candidates that are in truth apart are left to it.
Of those, a family of n similar texts that aren't linked asks for n / ``GROUP`` groups a text.
A comparison never joins what is one component by then, so a group of n members gives at most n - 1 links
and copies are never expanded into pairs.

Tokens are 64-bit hashes of shingles. Defined results: an empty or null text has no shingles and is
linked with nothing, not even its like; rows of one doc_id are one document, whatever their texts;
rows without doc_id take the component of documents of the same set, if any; repeated rows stay.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kinloom.llm.shingles import mix, overlap, tokens
from kinloom.llm.store import batches, drop, keep, small
from kinloom.operators.components import components

#: What near-duplicate stages take.
WORDS = 5
PERCENT = 80
#: What the registered query takes.
OP4_WORDS = 3
OP4_PERCENT = 90
#: Members of a token group, and the characters of their texts, about.
GROUP = 1024
GROUP_CHARS = 1 << 24
#: Queries that meet a group in one task, and the characters of their texts, about.
QUERIES = 1024
QUERY_CHARS = 1 << 25
#: Ratio of the largest to the smallest set of a size class.
CLASS = 1.5
#: Parts that a task sorts before it sends them, and texts they are of, at most (one text may have more parts).
SORTED_PARTS = 1 << 22
SORTED_TEXTS = 1 << 16
#: Occurrences of a part among the texts sorted together that go to the part's own bucket; the others are known to be shared.
ALONE = 2
#: Characters of text for each bucket of parts.
BUCKET_CHARS = 1 << 25


def _classes(most: int = 1 << 40) -> np.ndarray:
    low = [1]
    while low[-1] < most:
        low.append(max(low[-1] + 1, int(low[-1] * CLASS)))
    return np.array(low)


LOW = _classes()


def most_different(large: int, percent: int = PERCENT) -> int:
    """Most tokens in which two linked sets differ of which the smaller has at most ``large``."""
    # |x ^ y| <= (100 - p) / (100 + p) (|x| + |y|), and |y| <= 100 |x| / p
    return (100 - percent) * (large + 100 * large // percent) // (100 + percent)


def parts(own: np.ndarray, percent: int = PERCENT) -> tuple[np.ndarray, int]:
    """Keys of the parts of a set, and how many of them each set linked with it shares at least.

    Parts are those of its size class and, if it may be the larger of a pair, of classes below.
    """
    n = len(own)
    if not n:
        return np.empty(0, dtype=np.uint64), 1
    top = int(np.searchsorted(LOW, n, "right")) - 1
    out, need = [], []
    with np.errstate(over="ignore"):
        mixed = mix(own + np.uint64(77))
        for c in range(top, -1, -1):
            large = int(LOW[c + 1]) - 1
            if c < top and percent * n > 100 * large:
                break
            h = most_different(large, percent)
            spare = 4 + (h + 5) // 7
            total = h + 1 + spare
            place = (own % np.uint64(total)).astype(np.int64)
            order = np.argsort(place, kind="stable")
            run = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mixed[order], dtype=np.uint64)])
            ends = np.searchsorted(place[order], np.arange(total + 1))
            keys = mix(run[ends[1:]] - run[ends[:-1]] + mix(np.arange(total, dtype=np.uint64) * np.uint64(1 << 20) + np.uint64(c)))
            full = ends[1:] > ends[:-1]
            empty = total - int(full.sum())
            # At least spare + 1 parts are equal; those that are empty in both are empty in this one.
            out.append(keys[full] if empty <= spare else keys)
            need.append(max(1, spare + 1 - empty))
    return np.concatenate(out), min(need)


def digest(own: np.ndarray) -> tuple[int, int]:
    """128 bits that stand for a set."""
    with np.errstate(over="ignore"):
        pair = np.array([mix(own + np.uint64(1)).sum(dtype=np.uint64), mix(own ^ np.uint64(0x9E3779B97F4A7C15)).sum(dtype=np.uint64)])
    return tuple(pair.view(np.int64).tolist())


def linked(a: np.ndarray, b: np.ndarray, percent: int = PERCENT) -> bool:
    common = overlap(a, b)
    return common > 0 and 100 * common >= percent * (len(a) + len(b) - common)


# ---- parts that several sets share ----

_SENT = pa.schema([("b", pa.int32()), ("keys", pa.binary()), ("places", pa.binary()), ("rest", pa.binary()), *[(c, pa.int64()) for c in ("doc_id", "n_shingles", "d0", "d1", "need", "chars")]])
_FOUND = pa.schema([(c, pa.int64()) for c in ("part", "k", "doc_id", "n_shingles", "d0", "d1", "need", "chars")])
_FOUND_SQL = ", ".join(f"{f.name} long" for f in _FOUND)


def _rows(schema: pa.Schema, **columns) -> pa.RecordBatch:
    n = len(next(iter(columns.values())))
    return pa.record_batch([pa.array(columns[f.name], f.type) if f.name in columns else pa.nulls(n, f.type) for f in schema], schema=schema)


def _planes(x: np.ndarray) -> bytes:
    """Numbers byte by byte, all first bytes first, so that high zero bytes compress to nothing."""
    return np.ascontiguousarray(x.view(np.uint8).reshape(-1, x.itemsize).T).tobytes()


def _numbers(data: bytes, kind: type) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(size, -1).T).view(kind).ravel()


def _sent(own: list[np.ndarray], keys: list[int], buckets: int) -> Iterator[pa.RecordBatch]:
    """Rows for each bucket: sorted parts, and by which of the sets ``keys`` each is held."""
    part = np.concatenate(own)
    holder = np.repeat(np.arange(len(own), dtype=np.uint16), [len(x) for x in own])
    part = ((part >> np.uint64(32)) % np.uint64(buckets) << np.uint64(32)) | (part & np.uint64(0xFFFFFFFF))
    order = np.argsort(part, kind="stable")
    part, holder = part[order], holder[order]
    new = np.concatenate([[True], (part[1:] != part[:-1]) | (holder[1:] != holder[:-1])])
    part, holder = part[new], holder[new]
    begins = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]]))
    often = np.arange(len(part)) - np.repeat(begins, np.diff(np.append(begins, len(part)))) >= ALONE
    names = np.array(keys, dtype=np.int64)
    if often.any():
        known, of = part[often], names[holder[often]]
        for i in range(0, len(known), 1 << 16):
            yield _rows(_SENT, b=[int(of[i]) % buckets], keys=[of[i : i + (1 << 16)].tobytes()], rest=[known[i : i + (1 << 16)].tobytes()])
        part, holder = part[~often], holder[~often]
    bucket = (part >> np.uint64(32)).astype(np.int64)
    ends = np.append(np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]])), len(part))
    for i in range(0, len(ends) - 1, 64):
        rows: dict[str, list] = {"b": [], "keys": [], "places": [], "rest": []}
        for low, high in zip(ends[i : i + 64], ends[i + 1 : i + 65], strict=False):
            rest = (part[low:high] & np.uint64(0xFFFFFFFF)).astype(np.uint32)
            used, place = np.unique(holder[low:high], return_inverse=True)
            few = 4 * len(used) < 3 * (high - low)  # else each part names its set itself
            rows["b"].append(int(bucket[low]))
            rows["keys"].append((names[used] if few else names[holder[low:high]]).tobytes())
            rows["places"].append(_planes(place.astype(np.uint16)) if few else b"")
            rows["rest"].append(_planes(np.diff(rest, prepend=np.uint32(0))))
        yield _rows(_SENT, **rows)


def _send(size: int, percent: int, buckets: int):
    """A pass over the texts: a row for each document, and the parts of each set that the task meets first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple[int, int]] = set()
        own, keys, held, count = [], [], 0, 0
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch["doc_id"].to_pylist(), batch["text"], strict=True):
                text = text.as_py()
                mine = tokens(text, size)
                d, (part, need) = digest(mine), parts(mine, percent)
                count += 1
                rows.append((count % buckets, doc_id, len(mine), *d, need, len(text or "")))
                if len(mine) and doc_id is not None and d not in seen:
                    seen.add(d)
                    own.append(part)
                    keys.append(d[0])
                    held += len(part)
                    if held >= SORTED_PARTS or len(own) >= SORTED_TEXTS:
                        yield from _sent(own, keys, buckets)
                        own, keys, held = [], [], 0
            if rows:
                yield _rows(_SENT, **dict(zip(("b", "doc_id", "n_shingles", "d0", "d1", "need", "chars"), map(list, zip(*rows, strict=True)), strict=True)))
        if own:
            yield from _sent(own, keys, buckets)

    return run


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents as they are, and of a bucket's parts those that several sets hold."""
    all_parts, all_keys = [], []
    for batch in batches:
        if len(docs := batch.filter(batch["keys"].is_null())):
            yield pa.record_batch([pa.nulls(len(docs), pa.int64())] * 2 + [docs[c] for c in _FOUND.names[2:]], schema=_FOUND)
        for b, keys, places, rest in zip(*(batch[c].to_pylist() for c in ("b", "keys", "places", "rest")), strict=True):
            if keys is None:
                continue
            names = np.frombuffer(keys, np.int64)
            if places is None:
                yield _rows(_FOUND, part=np.frombuffer(rest, np.int64), k=names)
                continue
            all_parts.append(np.cumsum(_numbers(rest, np.uint32), dtype=np.uint64) | np.uint64(b << 32))
            all_keys.append(names[_numbers(places, np.uint16)] if places else names)
    if not all_parts:
        return
    part, key = np.concatenate(all_parts), np.concatenate(all_keys)
    del all_parts, all_keys
    order = np.argsort(part, kind="stable")
    part = part[order]
    again = part[1:] == part[:-1]
    twice = np.concatenate([[False], again]) | np.concatenate([again, [False]])
    part, key = part[twice], key[order[twice]]
    order = np.lexsort((key, part))
    part, key = part[order], key[order]
    new = np.concatenate([[True], (part[1:] != part[:-1]) | (key[1:] != key[:-1])]) if len(part) else np.empty(0, bool)
    part, key = part[new], key[new]
    again = part[1:] == part[:-1]
    twice = (np.concatenate([[False], again]) | np.concatenate([again, [False]])) if len(part) else np.empty(0, bool)
    part, key = part[twice].view(np.int64), key[twice]
    for i in range(0, len(part), 1 << 18):
        yield _rows(_FOUND, part=part[i : i + (1 << 18)], k=key[i : i + (1 << 18)])


def sets(docs: DataFrame, size: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """Rows (doc_id, n_shingles, d0, d1, need, chars) of documents, and rows (part, k) of parts that several sets share, k their d0.

    One pass over the texts and one exchange. A task sends the parts of equal sets once, and of a part that many
    of its sets hold only ``ALONE`` to the part's bucket, so a bucket doesn't grow with a group of copies.
    """
    spark = docs.sparkSession
    chars = docs.agg(F.sum(F.length("text"))).first()[0] or 0
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-chars // BUCKET_CHARS))
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    sent = own.mapInArrow(_send(size, percent, buckets), "b int, keys binary, places binary, rest binary, doc_id long, n_shingles long, d0 long, d1 long, need long, chars long")
    return sent.repartitionById(buckets, "b").mapInArrow(_shared, _FOUND_SQL)


# ---- the token-group matrix ----


class _Trees:
    """Which component each id is in, as far as known; ``join`` tells whether it was news."""

    def __init__(self) -> None:
        self.up: dict = {}

    def root(self, x):
        while (y := self.up.get(x, x)) != x:
            self.up[x] = self.up.get(y, y)
            x = y
        return x

    def join(self, x, y) -> None:
        self.up[self.root(x)] = self.root(y)


def _order(table: pa.Table, size: int) -> tuple[list[int], list[int], list[np.ndarray]]:
    """Ids, components and sets, the most central document first."""
    table = table.sort_by([("central", "descending"), ("doc_id", "ascending")])
    return table["doc_id"].to_pylist(), table["comp"].to_pylist(), [tokens(t.as_py(), size) for t in table["text"]]


def _fits(n: int, sizes: np.ndarray, common: int, percent: int) -> np.ndarray:
    """Members that can be linked with a set of ``n`` tokens, ``common`` of them in the union."""
    # Of linked sets 100 |x & y| >= p |x | y|, so (100 + p) |x & y| >= p (|x| + |y|).
    return np.flatnonzero((100 * n >= percent * sizes) & (percent * n <= 100 * sizes) & ((100 + percent) * common >= percent * (n + sizes)))


def _edges(a: list[int], b: list[int]) -> pa.Table:
    return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})


def _within(size: int, percent: int):
    """Links that join what isn't one component yet among the members of a group, each a query of its own group."""

    def run(group: pa.Table) -> pa.Table:
        a, b = [], []
        if len(group) > 1:
            ids, comps, inside = _order(group, size)
            sizes, trees = np.array([len(x) for x in inside]), _Trees()
            union, times = np.unique(np.concatenate(inside), return_counts=True)
            others = union[times > 1]  # what a member has in common with the union of the others
            for i in range(1, len(ids)):
                for j in _fits(len(inside[i]), sizes[:i], overlap(inside[i], others), percent):
                    if trees.root(comps[i]) != trees.root(comps[j]) and linked(inside[i], inside[j], percent):
                        trees.join(comps[i], comps[j])
                        a.append(ids[i])
                        b.append(ids[j])
        return _edges(a, b)

    return run


def _across(size: int, percent: int):
    """The same between queries and a group that isn't theirs; a query asks only for components of a higher rank."""

    def run(asked: pa.Table, group: pa.Table) -> pa.Table:
        a, b = [], []
        if len(asked) and len(group):
            group = group.rename_columns([c.removesuffix("_in") for c in group.column_names])
            ids, comps, inside = _order(group, size)
            sizes, trees = np.array([len(x) for x in inside]), _Trees()
            union = np.unique(np.concatenate(inside))
            for doc, comp, own in zip(*_order(asked, size), strict=True):
                for k in _fits(len(own), sizes, overlap(own, union), percent):
                    if trees.root(comp) != trees.root(comps[k]) and linked(own, inside[k], percent):
                        trees.join(comp, comps[k])
                        a.append(doc)
                        b.append(ids[k])
        return _edges(a, b)

    return run


def _cuts(of: DataFrame, key: str, rows: int, chars: int) -> DataFrame:
    """``key, cuts``: in how many groups the rows of a key go; ``chief``: their most central document."""
    size = F.greatest(F.count("*") / rows, F.sum("chars") / chars)
    return of.groupBy(key).agg(F.count("*").alias("n"), F.ceil(size).cast("long").alias("cuts"), F.max(F.struct("central", (-F.col("doc_id")).alias("first"), "comp", "chars")).alias("chief"))


def _placed(nodes: DataFrame, key: str, group: int, name: str) -> DataFrame:
    """``nodes`` with their group ``g`` by ``key``, where it has several members; each group of a key holds the key's chief too."""
    sizes = keep(_cuts(nodes, key, group, GROUP_CHARS).filter("n > 1"), f"{name}-sizes")
    g = F.xxhash64(F.lit(name), key, "cut").alias("g")
    own = nodes.join(sizes.select(key, "cuts"), key).withColumn("cut", F.pmod(F.xxhash64("doc_id"), "cuts"))
    chiefs = sizes.filter("cuts > 1").select(key, "chief.*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("cuts") - 1)).alias("cut")).withColumn("doc_id", -F.col("first"))
    out = own.select("doc_id", "comp", "central", "chars", g).union(chiefs.select("doc_id", "comp", "central", "chars", g))
    out = keep(out.distinct(), name)
    drop(sizes)
    return out


def _compared(texts: DataFrame, placed: DataFrame, size: int, percent: int, name: str) -> DataFrame:
    inside = texts.join(small(placed), "doc_id").select("g", "doc_id", "comp", "central", "text")
    return keep(inside.groupBy("g").applyInArrow(_within(size, percent), "a long, b long"), name)


def _met(texts: DataFrame, queries: DataFrame, members: DataFrame, size: int, percent: int) -> DataFrame:
    """Links between ``queries`` and ``members`` of the groups they are to meet; both (g, doc_id, comp, central, chars)."""
    load = keep(queries.groupBy("g").agg(F.ceil(F.greatest(F.count("*") / QUERIES, F.sum("chars") / QUERY_CHARS)).cast("long").alias("rounds")), "rounds")
    many = queries.join(load, "g").withColumn("s", F.pmod(F.xxhash64("doc_id"), F.col("rounds"))).join(texts, "doc_id").select("g", "s", "doc_id", "comp", "central", "text")
    few = members.join(load, "g").withColumn("s", F.explode(F.sequence(F.lit(0).cast("long"), F.col("rounds") - 1))).join(texts, "doc_id")
    few = few.select(*[F.col(c).alias(f"{c}_in") for c in ("g", "s", "doc_id", "comp", "central", "text")])
    out = keep(many.groupBy("g", "s").cogroup(few.groupBy("g_in", "s_in")).applyInArrow(_across(size, percent), "a long, b long"), "links-across")
    drop(load)
    return out


def _open(have: DataFrame, nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The shared parts that several components hold, with their most central holder; and their holders, where they hold enough of them."""
    whose = have.join(small(nodes.select("doc_id", "comp", "central")), "doc_id").select("part", "doc_id", "comp", "central")
    head = F.max(F.struct("central", (-F.col("doc_id")).alias("first"), "comp"))
    several = keep(whose.groupBy("part").agg(F.min("comp").alias("low"), F.max("comp").alias("high"), head.alias("head")).filter("low < high").select("part", "head"), "open-parts")
    holders = whose.select("part", "doc_id").join(several, "part")
    enough = holders.groupBy("doc_id").agg(F.count("*").alias("open")).join(nodes, "doc_id").filter("open >= need").drop("open")
    return several, keep(enough, "open")


def links(docs: DataFrame, found: DataFrame, size: int = WORDS, percent: int = PERCENT, group: int = GROUP, repeated: bool = False) -> DataFrame:
    """Links (a, b) that connect the components of class representatives; ``found`` is ``sets``, kept."""
    shared = found.filter("part IS NOT NULL").select("part", "k")
    reps = found.filter("n_shingles > 0 AND doc_id IS NOT NULL").groupBy("n_shingles", "d0", "d1").agg(F.min("doc_id").alias("doc_id"), F.min("need").alias("need"), F.max("chars").alias("chars"))
    counts = shared.groupBy("k").agg(F.count("*").alias("shared"))
    live = keep(reps.join(counts, F.col("d0") == F.col("k")).filter("shared >= need").select("k", "doc_id", "need", "chars"), "live")
    mine = shared.join(small(live.select("k", "doc_id")), "k").select("part", "doc_id")
    held = keep(mine.groupBy("part").agg(F.count("*").alias("n"), F.min("doc_id").alias("low"), F.max("doc_id").alias("high")).filter("low < high").select("part", "n"), "held")
    have = keep(mine.join(held, "part").select("part", "doc_id", "n"), "shared-parts")
    drop(held)
    facts = live.groupBy("doc_id").agg(F.min("need").alias("need"), F.max("chars").alias("chars"))
    central = have.groupBy("doc_id").agg(F.count("*").alias("shared"), F.sum("n").alias("central"))
    enough = keep(central.join(facts, "doc_id").filter("shared >= need").select("doc_id", "central", "need", "chars"), "enough")
    # A candidate's home is the document with which it shares most of the parts whose most central holder that is.
    whose = have.join(small(enough.select("doc_id", "central")), "doc_id").select("part", "doc_id", "central")
    heads = keep(whose.groupBy("part").agg(F.max(F.struct("central", (-F.col("doc_id")).alias("first")))["first"].alias("first")), "heads")
    votes = whose.select("part", "doc_id").join(heads, "part").groupBy("doc_id", "first").agg(F.count("*").alias("votes"))
    home = votes.groupBy("doc_id").agg((-F.max(F.struct("votes", "first"))["first"]).alias("home"))
    nodes = keep(enough.join(home, "doc_id").withColumn("comp", F.col("doc_id")), "nodes")
    drop(enough, heads)
    drop(live)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(small(nodes.select("doc_id")), "doc_id", "left_semi")
    texts = keep(texts.distinct() if repeated else texts, "texts")

    placed = _placed(nodes, "home", group, "home-groups")
    within = _compared(texts, placed, size, percent, "links-within")
    drop(placed)
    edges, now, several, left = _contracted(nodes, have, [within])
    if not left.isEmpty():
        edges.append(_rest(have, several, left, now, texts, size, percent, group))
    drop(several, left, now, have, nodes, texts)
    return _all(edges)


def _contracted(nodes: DataFrame, have: DataFrame, edges: list[DataFrame]) -> tuple[list[DataFrame], DataFrame, DataFrame, DataFrame]:
    """``edges``, and ``nodes`` with their components by them, and what is open between these."""
    whole = components(_all(edges))
    known = nodes.drop("comp").join(whole.toDF("doc_id", "component"), "doc_id", "left")
    now = keep(known.withColumn("comp", F.coalesce("component", "doc_id")).drop("component"), "contracted")
    drop(whole)
    return edges, now, *_open(have, now)


def _all(edges: list[DataFrame]) -> DataFrame:
    out = edges[0]
    for e in edges[1:]:
        out = out.union(e)
    return out


def _rest(have: DataFrame, several: DataFrame, left: DataFrame, now: DataFrame, texts: DataFrame, size: int, percent: int, group: int) -> DataFrame:
    """Step 2: of two candidates of different components, that of the smaller component (or lower name) meets the other's group."""
    ranks = keep(now.groupBy("comp").agg(F.count("*").alias("members")), "ranks")
    sizes = keep(_cuts(left, "home", group, GROUP_CHARS).select("home", "cuts"), "rest-sizes")
    own = left.join(sizes, "home").join(small(ranks), "comp").withColumn("g", F.xxhash64("home", F.pmod(F.xxhash64("doc_id"), "cuts")))
    own = keep(own.select("doc_id", "comp", "central", "chars", "need", "g", F.struct("members", "comp").alias("rank")), "rest")
    held = have.join(several.select("part"), "part", "left_semi").join(small(own.select("doc_id", "g", "rank", "need")), "doc_id")
    # Of need shared parts, however need - least are chosen and left out, least remain; the most crowded ones are left out.
    least = F.greatest(F.lit(1), F.floor(F.col("need") / 4))
    crowded = F.row_number().over(Window.partitionBy("doc_id").orderBy(F.col("n").desc(), "part"))
    holders = keep(held.withColumn("asks", crowded > F.col("need") - least).select("part", "doc_id", "g", "rank", "asks"), "holders")
    where = keep(holders.groupBy("part", "g").agg(F.max("rank").alias("top")), "where")
    asked = holders.filter("asks").select("part", "doc_id", "rank").join(where, "part").filter(F.col("rank") < F.col("top")).groupBy("doc_id", "g").agg(F.count("*").alias("parts"))
    queries = asked.join(own.drop("g", "rank"), "doc_id").filter(F.col("parts") >= least).select("g", "doc_id", "comp", "central", "chars")
    queries = keep(queries, "queries")
    out = _met(texts, queries, own, size, percent)
    drop(ranks, sizes, own, holders, where, queries)
    return out


def join(docs: DataFrame, size: int = WORDS, percent: int = PERCENT, group: int = GROUP) -> DataFrame:
    """``doc_id, n_shingles, component_id`` of each row of ``docs``."""
    with batches(docs.sparkSession):
        found = keep(sets(docs, size, percent), "sets")
        key = ["n_shingles", "d0", "d1"]
        rows = found.filter("part IS NULL").select("doc_id", *key)
        full = rows.filter("n_shingles > 0")
        several = keep(full.filter("doc_id IS NOT NULL").groupBy("doc_id").agg(F.count("*").alias("n"), F.min(F.struct(*key)).alias("x"), F.max(F.struct(*key)).alias("y")).filter("n > 1").select("doc_id", (F.col("x") < F.col("y")).alias("apart")), "several")
        repeated = not several.isEmpty()
        classes = keep(full.groupBy(*key).agg(F.min("doc_id").alias("rep"), F.count("*").alias("n")), "classes")
        edges = links(docs, found, size, percent, group, repeated)
        if repeated:
            # Rows of one doc_id with several sets stand in several classes, which they link.
            ties = full.join(small(several.filter("apart").select("doc_id")), "doc_id", "left_semi").join(classes, key).filter("doc_id <> rep")
            edges = edges.union(ties.select("doc_id", "rep"))
        whole = components(edges)
        # Classes of one row that nothing links keep their own id; so do texts without shingles.
        moved = classes.join(whole.toDF("rep", "component"), "rep", "left").filter("n > 1 OR component <> rep").select(*key, F.coalesce("component", "rep").alias("component"))
        moved = keep(moved, "moved")
        drop(whole, several, classes)
    out = full.join(small(moved), key, "left").select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))
    return out.union(rows.filter("n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id")))


def op4(spark, sf_dir: str) -> DataFrame:
    from kinloom.llm.tables import table

    return join(table(spark, sf_dir, "documents"), OP4_WORDS, OP4_PERCENT)


SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS (
  SELECT DISTINCT doc_id, token FROM (
    SELECT doc_id, array_to_string(w[i:i + 2], ' ') AS token FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 1, 2))) AS i FROM d WHERE len(w) > 0))
), n AS (
  SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), links AS (
  SELECT a, b FROM (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS k FROM s x JOIN s y ON x.token = y.token AND x.doc_id <> y.doc_id GROUP BY ALL) p
  JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * k >= 90 * (na.n + nb.n - k)
), reach(a, b) AS (
  SELECT doc_id, doc_id FROM d UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a
)
SELECT d.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, component_id FROM d LEFT JOIN n USING (doc_id)
JOIN (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a) USING (doc_id)
"""
