"""Token and set functions over arrays of strings, and similarities built from them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from kinloom.functions import vocab
from kinloom.functions.text import _c, norm_number


def words(x) -> Column:
    return F.filter(F.split(_c(x), r"\s+"), lambda t: t != "")


def among(t: Column, listed) -> Column:
    return F.array_contains(F.array(*map(F.lit, listed)), t)


def significant(x) -> Column:
    """Words that are neither stopwords nor corporate terms; if none is left, those that aren't stopwords."""
    plain = F.filter(words(x), lambda t: ~among(t, vocab.STOPWORDS["base"]))
    strict = F.filter(plain, lambda t: ~among(t, vocab.SUFFIXES["base"]))
    return F.when(F.size(strict) == 0, plain).otherwise(strict)


def name_words(x, version: str = "v1") -> Column:
    return F.filter(words(x), lambda t: ~among(t, vocab.STOPWORDS[version]) & ~among(t, vocab.SUFFIXES[version]) & (F.length(t) >= 2))


def meaningful(x, version: str = "serve") -> Column:
    return F.filter(words(x), lambda t: ~among(t, [*vocab.STOPWORDS[version], *vocab.SUFFIXES[version], *vocab.PREFIXES[version]]) & (F.length(t) >= 2))


def structural(x, version: str = "v1", least: int = 2) -> Column:
    """Leading prefixes and trailing suffixes taken off; if no unlisted word of ``least`` letters is left, the trimmed words."""
    front, back = [*vocab.PREFIXES[version], *vocab.STOPWORDS[version]], [*vocab.SUFFIXES[version], *vocab.STOPWORDS[version]]
    # A fold over the words: out has what stands between the first word that isn't in front and the last that isn't in back.
    start = F.struct(F.array().cast("array<string>").alias("out"), F.array().cast("array<string>").alias("tail"), F.lit(False).alias("on"))

    def step(acc, t):
        on = acc["on"] | ~among(t, front)
        ends = among(t, back)
        tail = F.when(on, F.concat(acc["tail"], F.array(t))).otherwise(acc["tail"])
        return F.struct(F.when(on & ~ends, F.concat(acc["out"], tail)).otherwise(acc["out"]).alias("out"), F.when(on & ~ends, F.slice(tail, 1, 0)).otherwise(tail).alias("tail"), on.alias("on"))

    listed = [*front, *vocab.SUFFIXES[version]]

    def choose(acc):
        kept = F.filter(acc["out"], lambda t: ~among(t, listed) & (F.length(t) >= least))
        return F.when(F.size(kept) == 0, acc["out"]).otherwise(kept)

    return F.aggregate(words(x), start, step, choose)


def numbers(tokens) -> Column:
    """Numerals of up to eight digits without leading zeros."""
    return F.filter(F.transform(F.filter(_c(tokens), lambda t: t.rlike(r"^\p{Nd}+$")), norm_number), lambda t: F.length(t) <= 8)


def postals(tokens) -> Column:
    return F.filter(numbers(tokens), lambda t: F.length(t).isin(5, 6))


def buildings(tokens) -> Column:
    return F.filter(numbers(tokens), lambda t: F.length(t) <= 4)


def localities(tokens, version: str = "serve", least: int = 3) -> Column:
    listed = [*vocab.GENERIC_ADDRESS[version], *vocab.STOPWORDS[version]]
    return F.filter(_c(tokens), lambda t: t.rlike(r"^\p{L}+$") & (F.length(t) >= least) & ~among(t, listed))


def first_of(a, fallback=None) -> Column:
    return F.coalesce(F.try_element_at(_c(a), F.lit(1)), *([] if fallback is None else [F.try_element_at(_c(fallback), F.lit(1))]), F.lit(""))


def last_of(a, fallback=None) -> Column:
    return F.coalesce(F.try_element_at(_c(a), F.lit(-1)), *([] if fallback is None else [F.try_element_at(_c(fallback), F.lit(-1))]), F.lit(""))


def signature(a) -> Column:
    return F.array_join(F.array_sort(F.array_distinct(_c(a))), "_")


def number_signature(a) -> Column:
    return F.array_join(F.slice(_c(a), 1, 4), "_")


def trigrams(x) -> Column:
    """Distinct runs of three characters; a shorter text is its own."""
    x = _c(x)
    runs = F.transform(F.sequence(F.lit(1), F.greatest(F.length(x) - 2, F.lit(1))), lambda i: F.substring(x, i, F.lit(3)))
    return F.when(x == "", F.array().cast("array<string>")).otherwise(F.array_distinct(runs))


def characters(x) -> Column:
    return F.array_distinct(F.filter(F.split(_c(x), ""), lambda t: t != ""))


def shared(a, b) -> Column:
    return F.size(F.array_intersect(_c(a), _c(b)))


def jaccard(a, b) -> Column:
    a, b = _c(a), _c(b)
    return F.when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(shared(a, b) / F.size(F.array_union(a, b)))


def containment(a, b) -> Column:
    a, b = _c(a), _c(b)
    return F.when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(shared(a, b) / F.least(F.size(F.array_distinct(a)), F.size(F.array_distinct(b))))


def common_prefix(a, b) -> Column:
    """Length of the longest common prefix."""
    a, b = _c(a), _c(b)
    n = F.least(F.length(a), F.length(b))
    return F.when(n == 0, 0).otherwise(F.size(F.filter(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.substring(a, F.lit(1), i) == F.substring(b, F.lit(1), i))))


def bounded_levenshtein(a, b, cap) -> Column:
    """The edit distance, or cap + 1 beyond the cap."""
    d = F.levenshtein(_c(a), _c(b))
    cap = F.lit(cap) if isinstance(cap, int) else cap
    return F.when(d > cap, cap + 1).otherwise(d)


def edit_similarity(a, b, least: int, share: float) -> Column:
    """1 - distance / longer length, the distance capped at max(least, share of the longer length)."""
    a, b = _c(a), _c(b)
    longer = F.greatest(F.length(a), F.length(b))
    cap = F.greatest(F.lit(least), F.floor(longer * F.lit(share)).cast("int"))
    return F.when(a == b, 1.0).otherwise(F.greatest(F.lit(0.0), 1.0 - bounded_levenshtein(a, b, cap) / longer))


def short_similarity(a, b, cap: int = 4) -> Column:
    a, b = _c(a), _c(b)
    return F.when((a == "") | (b == ""), 0.0).when(a == b, 1.0).otherwise(F.greatest(F.lit(0.0), 1.0 - bounded_levenshtein(a, b, cap) / F.greatest(F.length(a), F.length(b))))


def text_similarity(a, b) -> Column:
    """0.6 word Jaccard + 0.4 trigram Jaccard; 1 if equal but for case, 0 if one is empty."""
    a, b = F.lower(_c(a)), F.lower(_c(b))
    found = lambda x: F.array_distinct(F.regexp_extract_all(x, F.lit(r"[\p{L}\p{N}_]+"), F.lit(0)))
    return F.when((a == "") | (b == ""), 0.0).when(a == b, 1.0).otherwise(0.6 * jaccard(found(a), found(b)) + 0.4 * jaccard(trigrams(a), trigrams(b)))


def parse_ids(x) -> Column:
    """A comma list as an array: trimmed, without empty parts, brackets and quotes."""
    return F.filter(F.transform(F.split(F.regexp_replace(F.coalesce(_c(x), F.lit("")), r"[\[\]'\"]", ""), ","), lambda t: F.trim(t)), lambda t: t != "")


def distinct_in_order(a) -> Column:
    return F.array_distinct(_c(a))
