"""Snippets of DuckDB SQL that the checks are put together from; they are written apart from the Spark side."""

from __future__ import annotations

from kinloom.functions import vocab
from kinloom.plans.views import TRUTH_SQL, records_sql

q = lambda s: "'" + s.replace("'", "''") + "'"
listed = lambda words: "[" + ", ".join(map(q, dict.fromkeys(words))) + "]"


def rec(messy: bool = True) -> str:
    return f"rec AS ({records_sql(messy)})"


def truth() -> str:
    return f"truth AS ({TRUTH_SQL})"


def norm(x: str) -> str:
    return rf"trim(regexp_replace(lower(regexp_replace({x}, '[^\p{{L}}\p{{N}}_\s]', ' ', 'g')), '\s+', ' ', 'g'))"


def words(x: str) -> str:
    return rf"list_filter(regexp_split_to_array({x}, '\s+'), lambda t: t <> '')"


def number(x: str) -> str:
    return rf"CASE WHEN regexp_full_match({x}, '\p{{Nd}}+') THEN coalesce(nullif(ltrim({x}, '0'), ''), '0') ELSE {x} END"


def address(x: str, version: str = "serve") -> str:
    prefix = vocab.ADDRESS_PREFIX_FRENCH
    plain = rf"trim(regexp_replace(regexp_replace(regexp_replace(lower({x}), {q(prefix)}, ' ', 'gi'), '[^\p{{L}}\p{{N}}_\s]', ' ', 'g'), '\s+', ' ', 'g'))"
    table = "MAP {" + ", ".join(f"{q(k)}: {q(v)}" for k, v in vocab.ABBREVIATIONS[version].items()) + "}"
    return f"array_to_string(list_transform(list_filter(string_split({plain}, ' '), lambda t: t <> ''), lambda t: {number(f'coalesce({table}[t], t)')}), ' ')"


def domain(x: str) -> str:
    inner = f"regexp_replace(regexp_replace({x}, '^(?:https?://)?(?:www\\.)?', '', 'i'), '\\.(?:{'|'.join(vocab.DOMAIN_ENDS)})(?:/.*)?$', '', 'i')"
    return f"CASE WHEN strpos({x}, '.') = 0 AND strpos(lower({x}), 'www') = 0 THEN {x} ELSE {inner} END"


def compounds(x: str) -> str:
    return rf"list_transform(regexp_extract_all({x}, '\b(\d+[/_-]\d+)\b', 1), lambda t: array_to_string(list_transform(regexp_split_to_array(t, '[/_-]'), lambda u: {number('u')}), '_'))"


def meaningful(x: str, version: str = "serve") -> str:
    drop = listed([*vocab.STOPWORDS[version], *vocab.SUFFIXES[version], *vocab.PREFIXES[version]])
    return f"list_filter({words(x)}, lambda t: NOT list_contains({drop}, t) AND length(t) >= 2)"


def name_words(x: str, version: str = "v1") -> str:
    drop = listed([*vocab.STOPWORDS[version], *vocab.SUFFIXES[version]])
    return f"list_filter({words(x)}, lambda t: NOT list_contains({drop}, t) AND length(t) >= 2)"


def numbers(tokens: str) -> str:
    return rf"list_filter(list_transform(list_filter({tokens}, lambda t: regexp_full_match(t, '\p{{Nd}}+')), lambda t: {number('t')}), lambda t: length(t) <= 8)"


def localities(tokens: str, version: str = "serve") -> str:
    drop = listed([*vocab.GENERIC_ADDRESS[version], *vocab.STOPWORDS[version]])
    return rf"list_filter({tokens}, lambda t: regexp_full_match(t, '\p{{L}}+') AND length(t) >= 3 AND NOT list_contains({drop}, t))"


def trigrams(x: str) -> str:
    return f"CASE WHEN {x} = '' THEN [] ELSE list_distinct(list_transform(range(1, greatest(length({x}) - 2, 1) + 1), lambda i: substr({x}, i, 3))) END"


def distinct(a: str) -> str:
    """Distinct in order of first occurrence."""
    return f"list_filter({a}, lambda t, i: list_position({a}, t) = i)"


def shared(a: str, b: str) -> str:
    return f"len(list_intersect(list_distinct({a}), list_distinct({b})))"


def jaccard(a: str, b: str) -> str:
    return f"(CASE WHEN len({a}) = 0 OR len({b}) = 0 THEN 0.0 ELSE {shared(a, b)}::DOUBLE / len(list_distinct(list_concat({a}, {b}))) END)"


def containment(a: str, b: str) -> str:
    return f"(CASE WHEN len({a}) = 0 OR len({b}) = 0 THEN 0.0 ELSE {shared(a, b)}::DOUBLE / least(len(list_distinct({a})), len(list_distinct({b}))) END)"


def prefix(a: str, b: str) -> str:
    return f"len(list_filter(range(1, least(length({a}), length({b})) + 1), lambda i: substr({a}, 1, i) = substr({b}, 1, i)))"


def capped(a: str, b: str, cap: str) -> str:
    return f"(CASE WHEN levenshtein({a}, {b}) > {cap} THEN {cap} + 1 ELSE levenshtein({a}, {b}) END)"


def edit(a: str, b: str, least: int, share: float) -> str:
    longer = f"greatest(length({a}), length({b}))"
    cap = f"greatest({least}, floor({longer} * {share})::INT)"
    return f"(CASE WHEN {a} = {b} THEN 1.0 ELSE greatest(0.0, 1.0 - {capped(a, b, cap)}::DOUBLE / {longer}) END)"


def short(a: str, b: str, cap: int = 4) -> str:
    return f"(CASE WHEN {a} = '' OR {b} = '' THEN 0.0 WHEN {a} = {b} THEN 1.0 ELSE greatest(0.0, 1.0 - {capped(a, b, str(cap))}::DOUBLE / greatest(length({a}), length({b}))) END)"


def similarity(a: str, b: str) -> str:
    w = lambda x: rf"regexp_extract_all(lower({x}), '[\p{{L}}\p{{N}}_]+')"
    return f"(CASE WHEN {a} = '' OR {b} = '' THEN 0.0 WHEN lower({a}) = lower({b}) THEN 1.0 ELSE 0.6 * {jaccard(w(a), w(b))} + 0.4 * {jaccard(f'({trigrams(f'lower({a})')})', f'({trigrams(f'lower({b})')})')} END)"


def country(x: str) -> str:
    return f"CASE WHEN coalesce(trim({x}), '') = '' THEN 'UNKNOWN' ELSE upper(trim({x})) END"
