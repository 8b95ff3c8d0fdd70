"""Blocking: keys of records, their inverted index as a join, and pruning.

A key is ``COUNTRY|block|value``. Keys are exploded rows, so the inverted index is a hash partitioning
by key; long posting lists are pruned before the join, which is what keeps it from exploding.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinloom.functions import text as X
from kinloom.functions import tokens as T
from kinloom.functions import vocab


def _join(*parts) -> Column:
    """Parts joined by ``_``; null if one is empty."""
    parts = [F.col(p) if isinstance(p, str) else p for p in parts]
    empty = parts[0] == ""
    for p in parts[1:]:
        empty = empty | (p == "")
    return F.when(~empty, F.concat_ws("_", *parts))


def _at(a, i: int) -> Column:
    return F.coalesce(F.try_element_at(F.col(a) if isinstance(a, str) else a, F.lit(i)), F.lit(""))


def _linked(a: str, between: str, b: str) -> Column:
    """The two with ``between`` in the middle; null if one is empty."""
    return F.when((F.col(a) != "") & (F.col(b) != ""), F.concat(F.col(a), F.lit(between), F.col(b)))


def _some(x: Column, least: int = 1) -> Column:
    return F.when(F.length(x) >= least, x)


def _tag(tag: str, x: Column) -> Column:
    return F.when(x.isNotNull(), F.concat(F.lit(f"{tag}_"), x))


def pair_signature(words) -> Column:
    """The first two words, or a single one of three or more characters."""
    a, b = _at(words, 1), _at(words, 2)
    return F.when(b != "", F.concat_ws("_", a, b)).otherwise(_some(a, 3))


def key_fields(records: DataFrame, mode: str = "nfkd") -> DataFrame:
    """The fields that keys are built from: w (name words), a (address alphas), n (numbers), and others; ``mode`` as in ``text.fold``."""
    df = records.withColumns({"folded_name": X.fold("business_name", mode), "folded_address": X.fold("business_address", mode)})
    df = df.withColumns({"country_key": X.country("country"), "full": X.norm_name("folded_name"), "line": X.norm_name(X.strip_address_prefix("folded_address"))})
    df = df.withColumns({"w": T.name_words("full"), "s": T.structural("full"), "t": T.words("line"), "compounds": X.compound_numbers("business_address")})
    bare = X.strip_domain("folded_name")
    df = df.withColumns({"a": T.localities("t", "v1"), "n": T.numbers("t"), "domain_words": X.domain_words(bare), "is_domain": bare != F.col("folded_name"), "despaced": F.regexp_replace(X.norm_name(bare), " ", "")})
    return df.withColumns({"n0": _at("n", 1), "a0": _at("a", 1), "a9": _at("a", -1), "lead": _at("w", 1), "postal": _at(T.postals("n"), 1), "building": _at(T.buildings("n"), 1), "cmp0": _at("compounds", 1), "joined": F.array_join("s", "")})


def _narrow() -> dict[str, list[Column]]:
    alpha = F.when(F.col("a9") != F.col("a0"), _join("n0", "a9"))
    return {"B1": [_some(F.col("full"))], "B2": [pair_signature("w")], "B3": [_join("n0", "a0"), alpha], "B4": [_join("lead", "n0"), _join("lead", "a0")]}


def _wide() -> dict[str, list[Column]]:
    despaced = F.when(F.col("is_domain"), _some(F.col("despaced"), 4))
    j, n = F.col("joined"), F.length("joined")
    pre = lambda k: F.substring(j, F.lit(1), F.lit(k))
    suf = lambda k: F.substring(j, n - k + 1, F.lit(k))
    accent = X.norm_name("unmarked")
    odd = F.filter(T.words("full"), lambda t: t.rlike(r"[^\x00-\x7F]"))
    return {
        "w_A": _narrow()["B3"],  # and one for each compound number
        "w_B": [despaced, F.when(F.col("is_domain"), pair_signature("domain_words")), F.when(j != F.col("despaced"), _some(j, 4))],
        "w_C": [pair_signature("s")],
        "w_D": [F.when(n >= 5, F.concat_ws("_", pre(3), suf(3))), F.when(n == 4, pre(4)), _join("lead", F.substring(_at("w", 2), 1, 3))],
        "w_E": [F.when((F.col("postal") != "") & (F.col("building") != ""), F.concat(F.lit("p_"), F.col("postal"), F.lit("_b_"), F.col("building"))), _tag("pa", _join("postal", "a0")), _tag("ba", _join("building", "a9"))],
        "w_F": [_join("n0", "a0", "a9"), _tag("cmp", _join("cmp0", "a9")), _tag("pba", _join("postal", "building", "a0"))],
        "w_G": [_tag("acc", pair_signature(T.words(accent))), _tag("uni", pair_signature(odd))],
    }


def _pairing() -> dict[str, list[Column]]:
    """The wide blocks as labelled pairs are made with: A to C as there, and D to G in other forms."""
    core, name = _at("s", 1), F.col("business_name")
    long = F.length(core) >= 4
    indic = F.substring(F.regexp_replace(name, r"[^\p{L}\p{M}\p{N}]", ""), 1, 6)
    latin = T.words(X.norm_name("unmarked"))
    some_indic = name.rlike(r"[\u0900-\u0D7F]")
    return {b: columns for b, columns in _wide().items() if b in ("w_A", "w_B", "w_C")} | {
        "p_D": [_tag("pre", F.when(long, F.substring(core, 1, 3))), _tag("suf", F.when(long, F.substring(core, -3, 3)))],
        "p_E": [_tag("p", _linked("postal", "_b_", "building")), _tag("p", _linked("postal", "_a_", "a0")), _tag("b", _linked("building", "_a_", "a0"))],
        "p_F": [_join("cmp0", "postal"), _join("cmp0", "a0")],
        "p_G": [_tag("indic", F.when(some_indic, _some(indic, 3))), _tag("lat", F.when(~some_indic & name.rlike(r"[^\x00-\x7F]"), _join(_at(latin, 1), _at(latin, 2))))],
    }


def _serve() -> dict[str, list[Column]]:
    compact = X.compact("full")
    return _narrow() | {"s_BA": [_some(compact, 5), F.when(X.ocr(compact) != compact, _some(X.ocr(compact), 5))], "s_BC": [_join("building", "postal")]}


def _fast() -> dict[str, list[Column]]:
    words = F.filter(T.words(X.clean_fast("business_name")), lambda t: ~T.among(t, vocab.STOPWORDS["fast"]))
    house = F.regexp_extract("business_address", r"(\d+)", 1)
    return {"X1": [_some(X.clean_fast("business_name"))], "X2": [_join(_at(words, 1), _at(words, 2))], "X3": [_join(_at(words, 1), house)]}


GENERATORS = {"narrow": _narrow, "wide": _wide, "pairing": _pairing, "serve": _serve, "fast": _fast}


def keys(records: DataFrame, generator: str = "serve", blocks: list[str] | None = None) -> DataFrame:
    """entity_id, source, ord, block, key: distinct keys of each record.

    Text is folded as the generator's profile does: ``serve`` drops Latin accents, the others decompose.
    """
    found = GENERATORS[generator]()
    fields = key_fields(records, "latin" if generator == "serve" else "nfkd")
    if generator in ("wide", "pairing"):
        fields = fields.withColumn("unmarked", X.fold("business_name", "marks"))
    key = lambda b, v: F.struct(F.lit(b).alias("block"), F.concat_ws("|", "country_key", F.lit(b), v).alias("key"))
    listed = F.array(*[F.when(v.isNotNull(), key(b, v)) for b, values in found.items() if blocks is None or b in blocks for v in values])
    if "w_A" in found and (blocks is None or "w_A" in blocks):
        listed = F.concat(listed, F.transform("compounds", lambda x: F.when(x != "", key("w_A", F.concat(F.lit("cmp_"), x)))))
    # The array isn't a column of its own: a filter on its size would be pushed below the fields and evaluate them anew.
    return fields.select("entity_id", "source", "ord", F.inline(F.array_distinct(F.array_compact(listed))))


def prune(keyed: DataFrame, most: int, blocks: list[str] | None = None) -> DataFrame:
    """Without the keys that more than ``most`` rows have (of the given blocks, or of all)."""
    heavy = keyed.filter(F.col("block").isin(blocks) if blocks else F.lit(True)).groupBy("key").count().filter(F.col("count") > most).select("key")
    return keyed.join(heavy, "key", "left_anti")


def hits(s1_keys: DataFrame, other_keys: DataFrame) -> DataFrame:
    """s1, target, target_source, target_ord, block, key: one row for each shared key."""
    one = s1_keys.select("key", "block", F.col("entity_id").alias("s1"))
    two = other_keys.select("key", F.col("entity_id").alias("target"), F.col("source").alias("target_source"), F.col("ord").alias("target_ord"))
    return one.join(two, "key")


def evidence(found: DataFrame, count: str = "blocks") -> DataFrame:
    """One row for each pair: n_blocks (distinct blocks, or shared keys) and the sorted list of blocks."""
    n = F.countDistinct("block") if count == "blocks" else F.count("*")
    return found.groupBy("s1", "target", "target_source", "target_ord").agg(n.alias("n_blocks"), F.array_join(F.array_sort(F.collect_set("block")), ",").alias("blocks"))


def candidates(records: DataFrame, generator: str = "serve", most: int = 60, count: str = "keys") -> DataFrame:
    """Pairs of an S1 record and one of the other sources that share a key which at most ``most`` S1 records have."""
    keyed = keys(records, generator)
    return evidence(hits(prune(keyed.filter("source = 'S1'"), most), keyed.filter("source <> 'S1'")), count)


def cap_multi_single(pairs: DataFrame, multi: int = 15, single: int = 5) -> DataFrame:
    """The first ``multi`` targets of two or more blocks and the first ``single`` of one, in source order."""
    w = Window.partitionBy("s1", F.col("n_blocks") >= 2).orderBy("target_source", "target_ord")
    limit = F.when(F.col("n_blocks") >= 2, multi).otherwise(single)
    return pairs.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= limit).drop("rank")


def cap_total(pairs: DataFrame, most: int = 20) -> DataFrame:
    """At most ``most`` targets: those of two or more hits first, then in source order."""
    w = Window.partitionBy("s1").orderBy((F.col("n_blocks") >= 2).desc(), "target_source", "target_ord")
    return pairs.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= most).drop("rank")


def top_by_blocks(pairs: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("s1").orderBy(F.desc("n_blocks"), "target")
    return pairs.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k).drop("rank")


def adaptive_top(pairs: DataFrame, k: int) -> DataFrame:
    """All targets of two or more blocks, and the first k others."""
    w = Window.partitionBy("s1", F.col("n_blocks") >= 2).orderBy("target")
    return pairs.withColumn("rank", F.row_number().over(w)).filter((F.col("n_blocks") >= 2) | (F.col("rank") <= k)).drop("rank")


def label(pairs: DataFrame, truth: DataFrame) -> DataFrame:
    """Add ``label``: 1 where (s1, target) is a true pair."""
    known = truth.select("s1", "target", F.lit(1).alias("label")).distinct()
    return pairs.join(known, ["s1", "target"], "left").withColumn("label", F.coalesce("label", F.lit(0)))


def hard_negatives(labelled: DataFrame, k: int) -> DataFrame:
    """Per s1 the k negatives of most blocks; half as many where it has no positive. Positives stay."""
    w = Window.partitionBy("s1", "label").orderBy(F.desc("n_blocks"), "target_source", "target_ord")
    some = F.max("label").over(Window.partitionBy("s1"))
    ranked = labelled.withColumns({"rank": F.row_number().over(w), "some": some})
    limit = F.when(F.col("some") == 1, k).otherwise(k // 2)
    return ranked.filter((F.col("label") == 1) | (F.col("rank") <= limit)).drop("rank", "some")


def first_negatives(labelled: DataFrame, k: int = 50) -> DataFrame:
    """Positives and the first k negatives of each s1 in source order."""
    w = Window.partitionBy("s1", "label").orderBy("target_source", "target_ord")
    return labelled.withColumn("rank", F.row_number().over(w)).filter((F.col("label") == 1) | (F.col("rank") <= k)).drop("rank")


def split_bucket(id_column: str, buckets: int = 10) -> Column:
    """A bucket of an id by its MD5, the same in any engine."""
    return F.conv(F.substring(F.md5(F.col(id_column).cast("binary")), 1, 8), 16, 10).cast("long") % buckets
