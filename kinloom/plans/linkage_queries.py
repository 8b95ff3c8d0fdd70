"""Queries of blocking, candidates, features, decisions and evaluation over the derived records."""

from __future__ import annotations

from pyspark.sql import functions as F

from kinloom.functions import vocab
from kinloom.operators import blocking as B
from kinloom.operators import copies, decide, evaluate, shared
from kinloom.operators import features as Fe
from kinloom.operators import profiles as P
from kinloom.plans import duck as D
from kinloom.plans.registry import query
from kinloom.plans.views import records, truth_pairs
from kinloom.store import keep

# ---------------------------------------------------------------- SQL of the same steps, for the checks

NAME, ADDRESS = "business_name", "business_address"
_STRUCT_DROP = D.listed([*vocab.PREFIXES["v1"], *vocab.STOPWORDS["v1"], *vocab.SUFFIXES["v1"]])
_BEFORE = D.listed([*vocab.PREFIXES["v1"], *vocab.STOPWORDS["v1"]])
_AFTER = D.listed([*vocab.SUFFIXES["v1"], *vocab.STOPWORDS["v1"]])
_LINE = D.norm(f"regexp_replace({ADDRESS}, {D.q(vocab.ADDRESS_PREFIX)}, ' ', 'gi')")
_BARE = D.domain(NAME)

FIELDS = f"""
f0 AS (SELECT *, {D.country('country')} AS ck, {D.norm(NAME)} AS full_name, {_LINE} AS line, {D.compounds(ADDRESS)} AS comps, {_BARE} AS bare FROM rec),
f1 AS (SELECT *, {D.name_words('full_name')} AS w, {D.words('full_name')} AS allw, {D.words('line')} AS t, replace({D.norm('bare')}, ' ', '') AS despaced, bare <> {NAME} AS is_domain FROM f0),
f2 AS (SELECT *, list_min(list_filter(range(1, len(allw) + 1), lambda i: NOT list_contains({_BEFORE}, allw[i]))) AS lo, list_max(list_filter(range(1, len(allw) + 1), lambda i: NOT list_contains({_AFTER}, allw[i]))) AS hi,
  {D.localities('t', 'v1')} AS a, {D.numbers('t')} AS n FROM f1),
f3 AS (SELECT *, CASE WHEN lo IS NULL OR hi IS NULL OR hi < lo THEN [] ELSE allw[lo:hi] END AS cut FROM f2),
f4 AS (SELECT *, CASE WHEN len(list_filter(cut, lambda x: NOT list_contains({_STRUCT_DROP}, x) AND length(x) >= 2)) = 0 THEN cut ELSE list_filter(cut, lambda x: NOT list_contains({_STRUCT_DROP}, x) AND length(x) >= 2) END AS s FROM f3),
f AS (SELECT *, coalesce(n[1], '') AS n0, coalesce(a[1], '') AS a0, coalesce(a[-1], '') AS a9, coalesce(w[1], '') AS ld, coalesce(list_filter(n, lambda x: length(x) IN (5, 6))[1], '') AS postal,
  coalesce(list_filter(n, lambda x: length(x) <= 4)[1], '') AS bldg, coalesce(comps[1], '') AS cmp0, array_to_string(s, '') AS joined FROM f4)"""


def _j(*xs):
    return "CASE WHEN " + " AND ".join(f"{x} <> ''" for x in xs) + " THEN concat_ws('_', " + ", ".join(xs) + ") END"


def _sig(a):
    return f"CASE WHEN coalesce({a}[2], '') <> '' THEN concat_ws('_', {a}[1], {a}[2]) WHEN length({a}[1]) >= 3 THEN {a}[1] END"


def _t(tag, x):
    return f"'{tag}_' || ({x})"


_B3 = [_j("n0", "a0"), f"CASE WHEN a9 <> a0 THEN {_j('n0', 'a9')} END"]
_COMPACT = r"regexp_replace(full_name, '[^\p{L}\p{N}]', '', 'g')"
_OCR = f"translate({_COMPACT}, '01358@$', 'olesbas')"
_ACC = D.words("translate(full_name, 'àâäçéèêëîïôöùûüñ', 'aaaceeeeiioouuun')")
_ODD = r"list_filter(allw, lambda x: regexp_matches(x, '[^\x00-\x7F]'))"
#: Names behind domains are in lower case, so the pattern's look-ahead, which this engine lacks, has nothing to do.
_DOMAIN_WORDS = rf"list_filter(list_transform(regexp_extract_all(bare, '[A-Z]?[a-z]+|\d+'), lambda t: lower(t)), lambda t: length(t) >= 2 AND NOT list_contains({D.listed(vocab.STOPWORDS['base'])}, t))"
KEYS = {
    "B1": ["CASE WHEN length(full_name) >= 1 THEN full_name END"],
    "B2": [_sig("w")],
    "B3": _B3,
    "B4": [_j("ld", "n0"), _j("ld", "a0")],
    "w_A": [*[_t("cmp", f"comps[{i}]") for i in (1, 2, 3, 4)], *_B3],
    "w_B": [
        "CASE WHEN is_domain AND length(despaced) >= 4 THEN despaced END",
        f"CASE WHEN is_domain THEN {_sig(f'({_DOMAIN_WORDS})')} END",
        "CASE WHEN joined <> despaced AND length(joined) >= 4 THEN joined END",
    ],
    "w_C": [_sig("s")],
    "w_D": [
        "CASE WHEN length(joined) >= 5 THEN concat_ws('_', substr(joined, 1, 3), substr(joined, length(joined) - 2, 3)) END",
        "CASE WHEN length(joined) = 4 THEN substr(joined, 1, 4) END",
        _j("ld", "substr(coalesce(w[2], ''), 1, 3)"),
    ],
    "w_E": ["CASE WHEN postal <> '' AND bldg <> '' THEN 'p_' || postal || '_b_' || bldg END", _t("pa", _j("postal", "a0")), _t("ba", _j("bldg", "a9"))],
    "w_F": [_j("n0", "a0", "a9"), _t("cmp", _j("cmp0", "a9")), _t("pba", _j("postal", "bldg", "a0"))],
    "w_G": [_t("acc", _sig(f"({_ACC})")), _t("uni", _sig(f"({_ODD})"))],
    "p_D": [_t("pre", "CASE WHEN length(s[1]) >= 4 THEN substr(s[1], 1, 3) END"), _t("suf", "CASE WHEN length(s[1]) >= 4 THEN right(s[1], 3) END")],
    "p_E": ["CASE WHEN postal <> '' AND bldg <> '' THEN 'p_' || postal || '_b_' || bldg END", "CASE WHEN postal <> '' AND a0 <> '' THEN 'p_' || postal || '_a_' || a0 END", "CASE WHEN bldg <> '' AND a0 <> '' THEN 'b_' || bldg || '_a_' || a0 END"],
    "p_F": [_j("cmp0", "postal"), _j("cmp0", "a0")],
    "s_BA": [f"CASE WHEN length({_COMPACT}) >= 5 THEN {_COMPACT} END", f"CASE WHEN {_OCR} <> {_COMPACT} AND length({_OCR}) >= 5 THEN {_OCR} END"],
    "s_BC": [_j("bldg", "postal")],
    "X1": ["nullif(trim(regexp_replace(lower(business_name), '[^a-z0-9 ]', ' ', 'g')), '')"],
}
_FASTW = f"list_filter({D.words(chr(116) + 'rim(regexp_replace(lower(business_name), ' + D.q('[^a-z0-9 ]') + ', ' + D.q(' ') + ', ' + D.q('g') + '))')}, lambda t: NOT list_contains({D.listed(vocab.STOPWORDS['fast'])}, t))"
KEYS["X2"] = [_j(f"coalesce(({_FASTW})[1], '')", f"coalesce(({_FASTW})[2], '')")]
KEYS["X3"] = [_j(f"coalesce(({_FASTW})[1], '')", r"regexp_extract(business_address, '(\d+)', 1)")]


def keys_sql(blocks) -> str:
    """CTEs up to ``k`` (entity_id, source, ord, block, key)."""
    rows = ", ".join(f"('{b}', {v})" for b in blocks for v in KEYS[b])
    return f"{D.rec()}, {FIELDS}, k AS (SELECT DISTINCT entity_id, source, ord, block, ck || '|' || block || '|' || v AS key FROM f, LATERAL (VALUES {rows}) x(block, v) WHERE v IS NOT NULL)"


NARROW, SERVE = ["B1", "B2", "B3", "B4"], ["B1", "B2", "B3", "B4", "s_BA", "s_BC"]
WIDE = ["w_A", "w_C", "w_D", "w_E", "w_F", "w_G"]


def pairs_sql(blocks=tuple(SERVE), most: int = 60, count: str = "count(*)") -> str:
    """CTEs up to ``c`` (s1, target, target_source, target_ord, n_blocks, blocks)."""
    return f"""{keys_sql(blocks)}, heavy AS (SELECT key FROM k WHERE source = 'S1' GROUP BY key HAVING count(*) > {most}),
h AS (SELECT x.entity_id AS s1, y.entity_id AS target, y.source AS target_source, y.ord AS target_ord, x.block, x.key FROM k x JOIN k y USING (key) WHERE x.source = 'S1' AND y.source <> 'S1' AND x.key NOT IN (SELECT key FROM heavy)),
c AS (SELECT s1, target, target_source, target_ord, {count} AS n_blocks, array_to_string(list_sort(list_distinct(list(block))), ',') AS blocks FROM h GROUP BY ALL)"""


# ---------------------------------------------------------------- keys and candidates


def _keys(name, generator, blocks):
    query(name, f"WITH {keys_sql(blocks)} SELECT entity_id, block, key FROM k")(lambda spark, sf_dir: B.keys(records(spark, sf_dir), generator, list(blocks)).select("entity_id", "block", "key"))


for _b in NARROW:
    _keys(f"keys_{_b.lower()}", "narrow", [_b])
for _b in WIDE:
    _keys(f"keys_wide_{_b[-1].lower()}", "wide", [_b])
for _b in ("p_D", "p_E", "p_F"):
    _keys(f"keys_pairing_{_b[-1].lower()}", "pairing", [_b])
_keys("keys_serve_ba", "serve", ["s_BA"])
_keys("keys_serve_bc", "serve", ["s_BC"])
_keys("keys_fast", "fast", ["X1", "X2", "X3"])


_keys("keys_wide_b", "wide", ["w_B"])


_S1 = "source = 'S1'"


@query("posting_prune", f"WITH {keys_sql(NARROW)} SELECT entity_id, block, key FROM k WHERE source = 'S1' AND key NOT IN (SELECT key FROM k WHERE source = 'S1' GROUP BY key HAVING count(*) > 60)")
def posting_prune(spark, sf_dir):
    return B.prune(B.keys(records(spark, sf_dir), "narrow").filter(_S1), 60).select("entity_id", "block", "key")


@query("candidate_join", f"WITH {pairs_sql(NARROW)} SELECT s1, target, block, key FROM h")
def candidate_join(spark, sf_dir):
    k = B.keys(records(spark, sf_dir), "narrow")
    return B.hits(B.prune(k.filter(_S1), 60), k.filter("source <> 'S1'")).select("s1", "target", "block", "key")


def _pairs(spark, sf_dir, **more):
    return B.candidates(records(spark, sf_dir), **more)


_ALL = "s1, target, n_blocks"


@query("block_evidence", f"WITH {pairs_sql(count='count(DISTINCT block)')} SELECT s1, target, n_blocks, blocks FROM c")
def block_evidence(spark, sf_dir):
    return _pairs(spark, sf_dir, count="blocks").select("s1", "target", "n_blocks", "blocks")


@query("cap_multi_single", f"WITH {pairs_sql()} SELECT {_ALL} FROM c QUALIFY row_number() OVER (PARTITION BY s1, n_blocks >= 2 ORDER BY target_source, target_ord) <= CASE WHEN n_blocks >= 2 THEN 15 ELSE 5 END")
def cap_multi_single(spark, sf_dir):
    return B.cap_multi_single(_pairs(spark, sf_dir), 15, 5).select("s1", "target", "n_blocks")


@query("cap_twenty", f"WITH {pairs_sql()} SELECT {_ALL} FROM c QUALIFY row_number() OVER (PARTITION BY s1 ORDER BY n_blocks >= 2 DESC, target_source, target_ord) <= 20")
def cap_twenty(spark, sf_dir):
    return B.cap_total(_pairs(spark, sf_dir), 20).select("s1", "target", "n_blocks")


@query("topk_blocks", f"WITH {pairs_sql()} SELECT {_ALL} FROM c QUALIFY row_number() OVER (PARTITION BY s1 ORDER BY n_blocks DESC, target) <= 5")
def topk_blocks(spark, sf_dir):
    return B.top_by_blocks(_pairs(spark, sf_dir), 5).select("s1", "target", "n_blocks")


@query("adaptive_topk", f"WITH {pairs_sql()} SELECT {_ALL} FROM c QUALIFY n_blocks >= 2 OR row_number() OVER (PARTITION BY s1, n_blocks >= 2 ORDER BY target) <= 10")
def adaptive_topk(spark, sf_dir):
    return B.adaptive_top(_pairs(spark, sf_dir), 10).select("s1", "target", "n_blocks")


LABELLED = f"{pairs_sql()}, {D.truth()}, l AS (SELECT c.*, CASE WHEN truth.s1 IS NULL THEN 0 ELSE 1 END AS label FROM c LEFT JOIN truth USING (s1, target))"


def _labelled(spark, sf_dir):
    r = records(spark, sf_dir)
    return B.label(B.candidates(r), truth_pairs(r))


@query("label_pairs", f"WITH {LABELLED} SELECT s1, target, label FROM l")
def label_pairs(spark, sf_dir):
    return _labelled(spark, sf_dir).select("s1", "target", "label")


@query(
    "hard_negatives",
    f"WITH {LABELLED}, r AS (SELECT *, row_number() OVER (PARTITION BY s1, label ORDER BY n_blocks DESC, target_source, target_ord) AS k, max(label) OVER (PARTITION BY s1) AS known FROM l) SELECT s1, target, n_blocks, label FROM r WHERE label = 1 OR k <= CASE WHEN known = 1 THEN 20 ELSE 10 END",
)
def hard_negatives(spark, sf_dir):
    return B.hard_negatives(_labelled(spark, sf_dir), 20).select("s1", "target", "n_blocks", "label")


@query("first_negatives", f"WITH {LABELLED} SELECT s1, target, label FROM l QUALIFY label = 1 OR row_number() OVER (PARTITION BY s1, label ORDER BY target_source, target_ord) <= 50")
def first_negatives(spark, sf_dir):
    return B.first_negatives(_labelled(spark, sf_dir), 50).select("s1", "target", "label")


@query("md5_split", f"WITH {D.rec()} SELECT entity_id, (('0x' || substr(md5(entity_id), 1, 8))::UBIGINT % 10)::BIGINT AS bucket FROM rec")
def md5_split(spark, sf_dir):
    return records(spark, sf_dir).select("entity_id", B.split_bucket("entity_id").alias("bucket"))


# ---------------------------------------------------------------- features

_P2 = rf"""
p0 AS (SELECT entity_id, source, {NAME} AS raw, {ADDRESS} AS raw_address, {D.country('country')} AS country, {D.domain(NAME)} AS bare, {D.address(ADDRESS)} AS address FROM rec),
p1 AS (SELECT *, {D.norm(f"CASE WHEN length(trim(regexp_extract(bare, {D.q(vocab.FORMER_NAME)}, 1, 'i'))) > 3 THEN trim(regexp_extract(bare, {D.q(vocab.FORMER_NAME)}, 1, 'i')) ELSE bare END")} AS name FROM p0),
p2 AS (SELECT *, {D.words('name')} AS all_words, {D.meaningful('name')} AS words, {D.words('address')} AS aw, {D.compounds('raw_address')} AS comps, regexp_replace(name, '[^\p{{L}}\p{{N}}]', '', 'g') AS compact, regexp_replace(address, '[^\p{{L}}\p{{N}}]', '', 'g') AS acompact,
  CASE WHEN raw = '' THEN 'none' WHEN regexp_matches(raw, '[A-Za-z]') THEN 'latin' ELSE 'other' END AS script FROM p1),
p3 AS (SELECT *, {D.numbers('aw')} AS plain, translate(compact, '01358@$', 'olesbas') AS ocr, array_to_string(list_sort(list_distinct(words)), '_') AS sig, coalesce(words[1], all_words[1], '') AS first, coalesce(words[-1], all_words[-1], '') AS last,
  {D.trigrams('name')} AS ng, {D.trigrams('address')} AS ag, list_distinct(string_split(lower(raw), '')) AS chars, {D.localities('aw')} AS loc FROM p2),
p AS (SELECT *, list_distinct(list_concat(comps, plain)) AS nums, array_to_string(list_concat(comps, plain)[1:4], '_') AS nsig, coalesce(list_filter(plain, lambda t: length(t) <= 4)[1], '') AS building, coalesce(list_filter(plain, lambda t: length(t) IN (5, 6))[1], '') AS postal FROM p3)"""


def _eq(c):
    return f"CASE WHEN x.{c} <> '' AND x.{c} = y.{c} THEN 1.0 ELSE 0.0 END"


def _tri(c):
    return f"CASE WHEN x.{c} = '' OR y.{c} = '' THEN -1.0 WHEN x.{c} = y.{c} THEN 1.0 ELSE 0.0 END"


_GONE = "(x.address = '' OR y.address = '')"
FEATURE_SQL = {
    "name_exact_match": _eq("name"),
    "name_compact_match": _eq("compact"),
    "name_ocr_compact_match": _eq("ocr"),
    "name_sig_match": _eq("sig"),
    "name_char_len_s1": "length(x.name)",
    "name_char_len_cand": "length(y.name)",
    "name_char_len_diff": "abs(length(x.name) - length(y.name))",
    "name_char_len_ratio": "least(length(x.name), length(y.name))::DOUBLE / greatest(length(x.name), length(y.name), 1)",
    "name_char_sim": D.jaccard("x.ng", "y.ng"),
    "name_levenshtein_sim": D.edit("x.name", "y.name", 12, 0.5),
    "name_token_overlap": D.shared("x.words", "y.words"),
    "name_token_jaccard": D.jaccard("x.words", "y.words"),
    "name_token_containment": D.containment("x.words", "y.words"),
    "name_first_token_sim": D.short("x.first", "y.first"),
    "name_last_token_sim": D.short("x.last", "y.last"),
    "name_prefix_sim": f"{D.prefix('x.name', 'y.name')}::DOUBLE / greatest(length(x.name), length(y.name), 1)",
    "name_alphanumeric_sim": f"CASE WHEN x.compact = '' OR y.compact = '' THEN 0.0 ELSE {D.edit('x.compact', 'y.compact', 10, 0.4)} END",
    "addr_exact_match": _eq("address"),
    "addr_compact_match": _eq("acompact"),
    "addr_char_len_diff": "abs(length(x.address) - length(y.address))",
    "addr_char_len_ratio": f"CASE WHEN {_GONE} THEN 0.0 ELSE least(length(x.address), length(y.address))::DOUBLE / greatest(length(x.address), length(y.address), 1) END",
    "addr_char_sim": D.jaccard("x.ag", "y.ag"),
    "addr_levenshtein_sim": f"CASE WHEN {_GONE} THEN 0.0 ELSE {D.edit('x.address', 'y.address', 15, 0.5)} END",
    "addr_token_overlap": D.shared("x.aw", "y.aw"),
    "addr_token_jaccard": D.jaccard("x.aw", "y.aw"),
    "addr_token_containment": D.containment("x.aw", "y.aw"),
    "addr_numeric_overlap": D.shared("x.nums", "y.nums"),
    "addr_numeric_jaccard": D.jaccard("x.nums", "y.nums"),
    "addr_house_number_match": _tri("building"),
    "addr_postal_code_match": _tri("postal"),
    "addr_numeric_sig_match": _tri("nsig"),
    "addr_locality_token_overlap": D.shared("x.loc", "y.loc"),
    "addr_locality_jaccard": D.jaccard("x.loc", "y.loc"),
    "s1_addr_missing": "CASE WHEN x.address = '' THEN 1 ELSE 0 END",
    "cand_addr_missing": "CASE WHEN y.address = '' THEN 1 ELSE 0 END",
    "both_addr_missing": "CASE WHEN x.address = '' AND y.address = '' THEN 1 ELSE 0 END",
    "same_script": "CASE WHEN x.script = y.script THEN 1 ELSE 0 END",
    "script_type_latin": "CASE WHEN x.script = 'latin' OR y.script = 'latin' THEN 1 ELSE 0 END",
    "script_type_indic": "0",
    "script_char_overlap": D.jaccard("x.chars", "y.chars"),
    "country_match": "CASE WHEN x.country = y.country THEN 1 ELSE 0 END",
}
CROSS_SQL = {
    "name_addr_combined_sim": "0.65 * name_char_sim + 0.35 * addr_char_sim",
    "name_addr_harmonic_sim": "CASE WHEN name_char_sim + addr_char_sim = 0 THEN 0.0 ELSE 2 * name_char_sim * addr_char_sim / (name_char_sim + addr_char_sim) END",
    "both_strong": "CASE WHEN name_char_sim >= 0.70 AND addr_char_sim >= 0.60 THEN 1 ELSE 0 END",
    "name_strong_addr_weak": "CASE WHEN name_char_sim >= 0.80 AND addr_char_sim < 0.30 THEN 1 ELSE 0 END",
    "addr_strong_name_weak": "CASE WHEN addr_char_sim >= 0.80 AND name_char_sim < 0.40 THEN 1 ELSE 0 END",
}
SCORE = "least(1.0, greatest(0.0, 0.50 * name_char_sim + 0.20 * name_token_jaccard + 0.20 * addr_char_sim + 0.10 * name_exact_match))"
#: CTEs up to ``s`` (pairs, labels, features and score).
SCORED = (
    f"{LABELLED}, {_P2}, g0 AS (SELECT l.*, "
    + ", ".join(f"({v})::DOUBLE AS {k}" for k, v in FEATURE_SQL.items())
    + " FROM l JOIN p x ON x.entity_id = l.s1 JOIN p y ON y.entity_id = l.target), g AS (SELECT *, "
    + ", ".join(f"({v})::DOUBLE AS {k}" for k, v in CROSS_SQL.items())
    + f" FROM g0), s AS (SELECT *, {SCORE} AS score FROM g)"
)


def featured(spark, sf_dir):
    r = records(spark, sf_dir)
    pairs = B.label(B.candidates(r), truth_pairs(r))
    return Fe.features_v2(pairs, P.profile_v2(r))


def class_featured(spark, sf_dir):
    """(``featured`` by pairs of classes of equal records, with their sizes n1 and n2; the classes' members; the classes)."""
    found, of = copies.classes(records(spark, sf_dir), "truth_key")
    return Fe.features_v2(copies.candidates(found), P.profile_v2(found)), of, found


def scored(spark, sf_dir):
    return featured(spark, sf_dir).withColumn("score", Fe.linear_score())


def _select(name, columns):
    rounded = ", ".join(f"round({c}, 9) AS {c}" for c in columns)
    query(name, f"WITH {SCORED} SELECT s1, target, {rounded} FROM s")(lambda spark, sf_dir: featured(spark, sf_dir).select("s1", "target", *[F.round(c, 9).alias(c) for c in columns]))


_select("name_features", [c for c in FEATURE_SQL if c.startswith("name_")])
_select("addr_features", [c for c in FEATURE_SQL if "addr_" in c])
_select("script_features", [*Fe.SCRIPT_MORE, "country_match"])
_select("cross_features", list(CROSS_SQL))
_select("features_v2", Fe.V2)


@query("features_v1", f"WITH {SCORED} SELECT s1, target, {', '.join(f'round({c}, 9) AS {c}' for c in Fe.V1[:-1])}, n_blocks::DOUBLE AS num_blocks_matched FROM s")
def features_v1(spark, sf_dir):
    r = records(spark, sf_dir)
    return Fe.features_v1(B.candidates(r), P.profile_v2(r)).select("s1", "target", *[F.round(c, 9).alias(c) for c in Fe.V1])


_TRIGGER = f"strpos({NAME}, '.') = 0 AND strpos(lower({NAME}), 'www') = 0 AND strpos({NAME}, '/') = 0"
_BARE = f"regexp_replace(regexp_replace(trim({NAME}), '^(?:https?://)?(?:www\\.)?', '', 'i'), '\\.(?:{'|'.join(vocab.DOMAIN_ENDS_EARLY).replace('.', chr(92) + '.')})(?:/.*)?$', '', 'i')"
_EARLY_FRONT, _EARLY_BACK = [*vocab.PREFIXES["early"], *vocab.STOPWORDS["early"]], [*vocab.SUFFIXES["early"], *vocab.STOPWORDS["early"]]
_EARLY_COMPOUNDS = rf"list_transform(regexp_extract_all(raw_address, '\b(\d+[/_-]\d+[a-zA-Z]?)\b', 1), lambda t: array_to_string(list_transform(regexp_split_to_array(t, '[/_-]'), lambda u: {D.number('u')}), '/'))"
_PE = rf"""
e0 AS (SELECT entity_id, {ADDRESS} AS raw_address, {D.country('country')} AS country, CASE WHEN {_TRIGGER} THEN {NAME} ELSE {_BARE} END AS bare FROM rec),
e1 AS (SELECT *, {D.norm('bare')} AS name, {D.norm('raw_address')} AS address, {D.words(D.norm(f"regexp_replace(raw_address, {D.q(vocab.ADDRESS_PREFIX)}, ' ', 'gi')"))} AS sw FROM e0),
e2 AS (SELECT *, {D.words('name')} AS all_words, {D.words('address')} AS aw, regexp_replace(lower(bare), '[^\p{{L}}\p{{N}}]', '', 'g') AS compact, list_concat(CASE WHEN regexp_matches(raw_address, '[/-]') THEN {_EARLY_COMPOUNDS} ELSE [] END, {D.numbers('sw')}) AS nums FROM e1),
e3 AS (SELECT *, all_words[coalesce(list_min(list_filter(range(1, len(all_words) + 1), lambda i: NOT list_contains({D.listed(_EARLY_FRONT)}, all_words[i]))), len(all_words) + 1):] AS after FROM e2),
e4 AS (SELECT *, coalesce(list_max(list_filter(range(1, len(after) + 1), lambda i: NOT list_contains({D.listed(_EARLY_BACK)}, after[i]))), 0) AS stop FROM e3),
e5 AS (SELECT *, list_filter(after, lambda t, i: i <= stop) AS trimmed FROM e4),
e6 AS (SELECT *, list_filter(trimmed, lambda t: NOT list_contains({D.listed([*_EARLY_FRONT, *_EARLY_BACK])}, t)) AS strict FROM e5),
e7 AS (SELECT *, CASE WHEN len(strict) = 0 THEN trimmed ELSE strict END AS words FROM e6),
p AS (SELECT *, coalesce(words[1], all_words[1], '') AS first, coalesce(nums[1], '') AS building, {D.trigrams('name')} AS ng, {D.trigrams('address')} AS ag,
  list_filter(sw, lambda t: regexp_full_match(t, '\p{{L}}+') AND length(t) >= 2 AND NOT list_contains({D.listed([*vocab.GENERIC_ADDRESS['early'], *vocab.STOPWORDS['early']])}, t)) AS loc FROM e7)"""
_EARLY_SQL = {k: v for k, v in FEATURE_SQL.items() if k in Fe.EARLY} | {
    "addr_levenshtein_sim": f"CASE WHEN {_GONE} THEN 0.0 ELSE {D.edit('x.address', 'y.address', 15, 0.4)} END",
    "country_match": "CASE WHEN x.country = y.country AND x.country <> 'UNKNOWN' THEN 1 ELSE 0 END",
}
_EARLY_CROSS = {
    "name_addr_combined_sim": "0.55 * name_levenshtein_sim + 0.45 * addr_levenshtein_sim",
    "name_addr_harmonic_sim": "2.0 * name_levenshtein_sim * addr_levenshtein_sim / (name_levenshtein_sim + addr_levenshtein_sim + 1e-6)",
    "both_strong": "CASE WHEN (name_token_jaccard >= 0.5 OR name_levenshtein_sim >= 0.7) AND (addr_token_jaccard >= 0.4 OR addr_levenshtein_sim >= 0.6) THEN 1 ELSE 0 END",
    "name_strong_addr_weak": "CASE WHEN (name_token_jaccard >= 0.7 OR name_levenshtein_sim >= 0.8) AND addr_token_jaccard < 0.2 AND addr_levenshtein_sim < 0.35 THEN 1 ELSE 0 END",
    "addr_strong_name_weak": "CASE WHEN (addr_token_jaccard >= 0.65 OR addr_levenshtein_sim >= 0.7) AND name_token_jaccard < 0.25 AND name_levenshtein_sim < 0.45 THEN 1 ELSE 0 END",
}


@query(
    "features_early",
    f"WITH {LABELLED}, {_PE}, early AS (SELECT l.s1, l.target, "
    + ", ".join(f"({v})::DOUBLE AS {k}" for k, v in _EARLY_SQL.items())
    + " FROM l JOIN p x ON x.entity_id = l.s1 JOIN p y ON y.entity_id = l.target), crossed AS (SELECT *, "
    + ", ".join(f"({v})::DOUBLE AS {k}" for k, v in _EARLY_CROSS.items())
    + f" FROM early) SELECT s1, target, {', '.join(f'round({c}, 9) AS {c}' for c in Fe.EARLY)} FROM crossed",
)
def features_early(spark, sf_dir):
    r = records(spark, sf_dir)
    return Fe.features_early(B.candidates(r).select("s1", "target"), P.profile_early(r)).select("s1", "target", *[F.round(c, 9).alias(c) for c in Fe.EARLY])


_SOME = ["name_char_sim", "addr_char_sim", "name_levenshtein_sim", "addr_house_number_match"]


@query(
    "feature_summary",
    f"WITH {SCORED} " + " UNION ALL ".join(f"SELECT '{c}' AS feature, round(min({c}), 6) AS min, round(avg({c}), 6) AS mean, round(quantile_cont({c}, 0.5), 6) AS median, round(max({c}), 6) AS max, (count(*) - count({c}))::DOUBLE AS nulls FROM s" for c in _SOME),
)
def feature_summary(spark, sf_dir):
    return Fe.summary(featured(spark, sf_dir), _SOME).select("feature", *[F.round(c, 6).alias(c) for c in ("min", "mean", "median", "max")], "nulls")


@query("hard_negative_flags", f"WITH {SCORED} SELECT s1, target, label, h AS hard, (CASE WHEN h = 1 THEN 2.5 ELSE 1.0 END)::DOUBLE AS weight FROM (SELECT *, CASE WHEN label = 0 AND (name_char_sim >= 0.7 OR addr_char_sim >= 0.7 OR name_exact_match = 1) THEN 1 ELSE 0 END AS h FROM s)")
def hard_negative_flags(spark, sf_dir):
    return Fe.hard_negative_flags(featured(spark, sf_dir)).select("s1", "target", "label", "hard", "weight")


# ---------------------------------------------------------------- decisions

_AGREE = "(name_exact_match = 1 OR {} OR addr_house_number_match = 1)"
_GIVEN = "score >= 0.65 AND s1_addr_missing = 0 AND cand_addr_missing = 0"
RULE_SQL = {
    "flat": "SELECT * FROM s WHERE score >= 0.4365",
    "margin": "SELECT * FROM s QUALIFY score >= CASE WHEN max(score) OVER (PARTITION BY s1) >= 0.85 THEN greatest(0.60, max(score) OVER (PARTITION BY s1) - 0.25) ELSE 0.60 END",
    "tested": f"SELECT * FROM s WHERE score >= 0.75 OR (score >= 0.58 AND {_AGREE.format('both_strong = 1')})",
    "shipped": f"SELECT * FROM s WHERE score >= 0.75 OR (score >= 0.58 AND {_AGREE.format(f'({_GIVEN})')})",
    "documented": f"SELECT * FROM s WHERE score >= 0.75 OR (score >= 0.58 AND {_AGREE.format('score >= 0.65')})",
}
for _name, _key in (("flat", "rule_flat"), ("margin", "rule_margin"), ("tested", "rule_agreement_tested"), ("shipped", "rule_agreement_shipped"), ("documented", "rule_agreement_documented")):
    query(_key, f"WITH {SCORED}, m AS ({RULE_SQL[_name]}) SELECT s1, target, round(score, 6) AS score FROM m")(
        lambda spark, sf_dir, rule=decide.RULES[_name]: rule(scored(spark, sf_dir)).select("s1", "target", F.round("score", 6).alias("score"))
    )

_MATCHED = f"{SCORED}, m AS ({RULE_SQL['shipped']})"
_TRUTHFUL = "e AS (SELECT entity_id AS s1 FROM rec WHERE source = 'S1')"


def class_matches(spark, sf_dir):
    """(the matching pairs of classes of equal records; the classes' members; the classes)"""
    pairs, of, found = class_featured(spark, sf_dir)
    return decide.agreement_shipped(pairs.withColumn("score", Fe.linear_score())), of, found


def matches(spark, sf_dir):
    """Whether a pair matches is decided once a pair of classes."""
    pairs, of, _ = class_matches(spark, sf_dir)
    return copies.members(pairs, of, "label", "score")


@query("er_match_lists", f"WITH {_MATCHED} SELECT entity_id, coalesce((SELECT string_agg(target, ',' ORDER BY target_ord, target) FROM m WHERE m.s1 = rec.entity_id), '') AS matched FROM rec WHERE source = 'S1'")
def er_match_lists(spark, sf_dir):
    return decide.match_lists(records(spark, sf_dir), matches(spark, sf_dir))


@query("matches_by_probability", f"WITH {_MATCHED} SELECT s1, string_agg(target, ',' ORDER BY score DESC, target) AS matched FROM (SELECT s1, target, round(score, 9) AS score FROM m) GROUP BY s1")
def matches_by_probability(spark, sf_dir):
    return decide.by_probability(matches(spark, sf_dir).withColumn("score", F.round("score", 9)))


_FS = f"list_filter({D.words('n')}, lambda t: NOT list_contains({D.listed(vocab.STOPWORDS['fast'])}, t))"


@query(
    "rule_heuristic",
    f"""WITH {keys_sql(["X1", "X2", "X3"])}, h AS (SELECT DISTINCT x.entity_id AS s1, y.entity_id AS target, y.ord AS target_ord, y.source AS target_source, x.block FROM k x JOIN k y USING (key) WHERE x.source = 'S1' AND y.source <> 'S1'),
    b AS (SELECT s1, target, target_source, target_ord, max(block = 'X1') AS exact, max(block = 'X3') AS house FROM h GROUP BY ALL), n AS (SELECT entity_id, trim(regexp_replace(lower(business_name), '[^a-z0-9 ]', ' ', 'g')) AS n FROM rec), t AS (SELECT entity_id, {_FS} AS t FROM n),
    d AS (SELECT s1, target, target_source, target_ord FROM b JOIN t x ON x.entity_id = s1 JOIN t y ON y.entity_id = target WHERE exact OR {D.jaccard('x.t', 'y.t')} >= 0.6 OR (house AND {D.shared('x.t', 'y.t')} > 0))
    SELECT s1, target FROM d QUALIFY row_number() OVER (PARTITION BY s1 ORDER BY target_source, target_ord) <= 10""",
)
def rule_heuristic(spark, sf_dir):
    """The path without a model: an exact name, name words of Jaccard 0.6, or a house number and a shared word; ten a record."""
    return heuristic(records(spark, sf_dir)).select("s1", "target")


def heuristic(recs, most: int = 10):
    from kinloom.functions import text as X
    from kinloom.functions import tokens as T

    found, of = copies.classes(recs)
    sides = found.select("entity_id", "n1", "n2", F.filter(T.words(X.clean_fast("business_name")), lambda t: ~T.among(t, vocab.STOPWORDS["fast"])).alias("t"))
    k = keep(B.keys(found, "fast").select("entity_id", "block", "key").join(sides, "entity_id"), "fast-keys")
    one, two = k.filter("n1 > 0").select("key", "block", F.col("entity_id").alias("s1")), k.filter("n2 > 0").select("key", F.col("entity_id").alias("target"))
    met = one.join(two, "key").groupBy("s1", "target").agg(F.bool_or(F.col("block") == "X1").alias("exact"), F.bool_or(F.col("block") == "X3").alias("house"))
    both = met.join(sides.select(F.col("entity_id").alias("s1"), F.col("t").alias("t1")), "s1").join(sides.select(F.col("entity_id").alias("target"), F.col("t").alias("t2")), "target")
    good = both.filter(F.col("exact") | (T.jaccard("t1", "t2") >= 0.6) | (F.col("house") & (T.shared("t1", "t2") > 0)))
    return copies.first_targets(good, of, most)


# ---------------------------------------------------------------- evaluation

_r = lambda *names: ", ".join(f"round({n}, 6) AS {n}" for n in names)


def _rounded(df, names):
    return df.select(*[F.round(c, 6).alias(c) if c in names else F.col(c) for c in df.columns])


def _s1(spark, sf_dir):
    return records(spark, sf_dir).filter(_S1).select(F.col("entity_id").alias("s1"))


_STRAT = f"{pairs_sql(most=10**9)}, {D.truth()}, {_TRUTHFUL}, st AS (SELECT DISTINCT block AS strategy, s1, target FROM h)"
_UNION = "u AS (SELECT * FROM st UNION SELECT 'old union', s1, target FROM st WHERE strategy IN ('B1', 'B2', 'B3', 'B4') UNION SELECT 'union', s1, target FROM st)"
_BM = """n AS (SELECT strategy, e.s1, count(u.target) AS n FROM (SELECT DISTINCT strategy FROM u) q CROSS JOIN e LEFT JOIN u USING (strategy, s1) GROUP BY ALL),
z AS (SELECT strategy, sum(n)::BIGINT AS candidates, avg(n) AS mean, quantile_cont(n, 0.5) AS median, max(n) AS most, count(*) FILTER (n = 0) AS without FROM n GROUP BY ALL),
fnd AS (SELECT strategy, count(*) AS found, count(DISTINCT s1) AS entities FROM u JOIN truth USING (s1, target) GROUP BY ALL)
SELECT strategy, candidates, round(mean, 6) AS mean, median::DOUBLE AS median, most, without, round(coalesce(found, 0) / (SELECT count(*) FROM truth), 6) AS pair_recall, round(coalesce(entities, 0) / (SELECT count(DISTINCT s1) FROM truth), 6) AS entity_recall FROM z LEFT JOIN fnd USING (strategy)"""


def _tally(spark, sf_dir, strategies, most=None):
    """Numbers of pairs by strategy (strategy, n, found, times), without the pairs."""
    return shared.counts(shared.posted(records(spark, sf_dir), most=most), strategies)


def _bm(spark, sf_dir, strategies):
    tally = keep(_tally(spark, sf_dir, strategies | {shared.TRUTH: [shared.TRUTH]}), "tally")
    true = F.col("strategy") == shared.TRUTH
    return _rounded(evaluate.blocking_counts(_s1(spark, sf_dir), tally.filter(~true), tally.filter(true)), ("mean", "pair_recall", "entity_recall"))


@query("blocking_metrics", f"WITH {_STRAT}, u AS (SELECT * FROM st), {_BM}")
def blocking_metrics(spark, sf_dir):
    return _bm(spark, sf_dir, SINGLE)


SINGLE = {b: [b] for b in SERVE}
UNIONS = {"old union": NARROW, "union": SERVE}


@query("strategy_union_recall", f"WITH {_STRAT}, {_UNION}, {_BM}")
def strategy_union_recall(spark, sf_dir):
    return _bm(spark, sf_dir, SINGLE | UNIONS)


@query("candidate_growth", f"WITH {_STRAT}, {_UNION} SELECT round(100.0 * (count(*) FILTER (strategy = 'union') - count(*) FILTER (strategy = 'old union')) / count(*) FILTER (strategy = 'old union'), 6) AS growth_percent FROM u")
def candidate_growth(spark, sf_dir):
    n = lambda s: F.coalesce(F.sum(F.when(F.col("strategy") == s, F.col("n") * F.col("times"))), F.lit(0))
    return _tally(spark, sf_dir, UNIONS).agg(F.round(100.0 * (n("union") - n("old union")) / n("old union"), 6).alias("growth_percent"))


@query("new_block_recovery", f"WITH {_STRAT}, hit AS (SELECT * FROM st JOIN truth USING (s1, target)) SELECT strategy, count(*) AS recovered FROM hit WHERE strategy LIKE 's%' AND (s1, target) NOT IN (SELECT (s1, target) FROM hit WHERE strategy LIKE 'B%') GROUP BY ALL")
def new_block_recovery(spark, sf_dir):
    """What a new block adds to the old ones' true pairs is the difference of two counts."""
    wider = {b: [*NARROW, b] for b in SERVE if b not in NARROW}
    found = _tally(spark, sf_dir, wider | {"old": NARROW}).groupBy("strategy").agg(F.sum(F.col("found") * F.col("times")).alias("n"))
    old = found.agg(F.coalesce(F.sum(F.when(F.col("strategy") == "old", F.col("n"))), F.lit(0)).alias("old"))
    return found.filter("strategy <> 'old'").join(F.broadcast(old)).select("strategy", (F.col("n") - F.col("old")).alias("recovered")).filter("recovered > 0")


_ENT = f"""{_MATCHED}, {_TRUTHFUL}, j AS (SELECT s1, count(*) FILTER (p AND t) AS tp, count(*) FILTER (p AND NOT t) AS fp, count(*) FILTER (t AND NOT p) AS fn FROM
(SELECT coalesce(m.s1, truth.s1) AS s1, m.s1 IS NOT NULL AS p, truth.s1 IS NOT NULL AS t FROM m FULL JOIN truth ON m.s1 = truth.s1 AND m.target = truth.target) GROUP BY ALL),
i AS (SELECT e.s1, coalesce(tp, 0) AS tp, coalesce(fp, 0) AS fp, coalesce(fn, 0) AS fn FROM e LEFT JOIN j USING (s1)),
en AS (SELECT s1, tp, fp, fn, tp + fn AS n_true, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) WHEN tp + fn = 0 THEN 1.0 ELSE 0.0 END::DOUBLE AS precision, CASE WHEN tp + fn > 0 THEN tp / (tp + fn) WHEN fp = 0 THEN 1.0 ELSE 0.0 END::DOUBLE AS recall,
 CASE WHEN tp + fn = 0 THEN CASE WHEN fp = 0 THEN 1.0 ELSE 0.0 END WHEN tp = 0 THEN 0.0 ELSE 1.25 * tp / (1.25 * tp + 0.25 * fn + fp) END::DOUBLE AS f, CASE WHEN fp = 0 AND fn = 0 THEN 1 ELSE 0 END AS exact FROM i)"""


def _entities(spark, sf_dir):
    return evaluate.per_entity(_s1(spark, sf_dir), matches(spark, sf_dir), truth_pairs(records(spark, sf_dir)))


@query("entity_f05", f"WITH {_ENT} SELECT s1, tp, fp, fn, n_true, {_r('precision', 'recall', 'f')}, exact FROM en")
def entity_f05(spark, sf_dir):
    return _rounded(_entities(spark, sf_dir), ("precision", "recall", "f"))


_MACRO = """SELECT count(*) AS entities, round(avg(f), 6) AS macro_f, round(avg(precision), 6) AS macro_precision, round(avg(recall), 6) AS macro_recall, round(avg(exact), 6) AS exact_rate,
round(coalesce(count(*) FILTER (n_true = 0 AND fp = 0) / nullif(count(*) FILTER (n_true = 0), 0), 0), 6)::DOUBLE AS singleton_accuracy, round(coalesce(count(*) FILTER (n_true = 0 AND fp > 0) / nullif(count(*) FILTER (n_true = 0), 0), 0), 6)::DOUBLE AS singleton_fp_rate,
sum(tp)::BIGINT AS tp, sum(fp)::BIGINT AS fp, sum(fn)::BIGINT AS fn, round(coalesce(sum(tp) / nullif(sum(tp) + sum(fp), 0), 0), 6)::DOUBLE AS pair_precision, round(coalesce(sum(tp) / nullif(sum(tp) + sum(fn), 0), 0), 6)::DOUBLE AS pair_recall, round(avg(fp), 6) AS mean_fp, round(avg(fn), 6) AS mean_fn FROM en"""


@query("macro_metrics", f"WITH {_ENT} {_MACRO}")
def macro_metrics(spark, sf_dir):
    m = evaluate.macro(_entities(spark, sf_dir))
    return _rounded(m, [c for c in m.columns if c not in ("entities", "tp", "fp", "fn")])


@query("singleton_metrics", f"WITH {_ENT}, mm AS ({_MACRO}) SELECT singleton_accuracy, singleton_fp_rate FROM mm")
def singleton_metrics(spark, sf_dir):
    return macro_metrics(spark, sf_dir).select("singleton_accuracy", "singleton_fp_rate")


@query(
    "candidate_stats",
    f"""WITH {LABELLED}, {_TRUTHFUL}, n AS (SELECT e.s1, count(c.target) AS n FROM e LEFT JOIN c USING (s1) GROUP BY ALL) SELECT sum(n)::BIGINT AS candidates, round(avg(n), 6) AS mean, quantile_cont(n, 0.5)::DOUBLE AS median, round(quantile_cont(n, 0.95)::DOUBLE, 6) AS p95, round(quantile_cont(n, 0.99)::DOUBLE, 6) AS p99,
    max(n) AS most, count(*) FILTER (n = 0) AS without, (SELECT round(count(*) FILTER (c.s1 IS NOT NULL) / count(*), 6) FROM truth LEFT JOIN c USING (s1, target)) AS recall FROM n""",
)
def candidate_stats(spark, sf_dir):
    tally = keep(_tally(spark, sf_dir, {"all": SERVE, shared.TRUTH: [shared.TRUTH]}, 60), "tally")
    of = lambda name: tally.filter(F.col("strategy") == name)
    return _rounded(evaluate.candidate_counts(_s1(spark, sf_dir), of("all"), of(shared.TRUTH)), ("mean", "p95", "p99", "recall"))


_GRID = [round(0.3 + 0.02 * i, 2) for i in range(31)]
_SWEEP = f"""{SCORED}, {_TRUTHFUL}, q AS (SELECT unnest({_GRID}) AS threshold), tn AS (SELECT e.s1, count(truth.target) AS n FROM e LEFT JOIN truth USING (s1) GROUP BY ALL),
y AS (SELECT threshold, tn.s1, n, count(s.target) FILTER (s.label = 1) AS tp, count(s.target) FILTER (s.label = 0) AS fp FROM q CROSS JOIN tn LEFT JOIN s ON s.s1 = tn.s1 AND round(s.score, 9) >= threshold GROUP BY ALL),
sw AS (SELECT threshold, avg(CASE WHEN n = 0 THEN CASE WHEN fp = 0 THEN 1.0 ELSE 0.0 END WHEN tp = 0 THEN 0.0 ELSE 1.25 * tp / (1.25 * tp + 0.25 * (n - tp) + fp) END)::DOUBLE AS macro_f05, coalesce(sum(tp) / nullif(sum(tp + fp), 0), 0)::DOUBLE AS pair_precision, coalesce(sum(tp) / nullif(sum(n), 0), 0)::DOUBLE AS pair_recall,
coalesce(count(*) FILTER (n = 0 AND fp > 0) / nullif(count(*) FILTER (n = 0), 0), 0)::DOUBLE AS singleton_fp_rate, avg(tp + fp) AS avg_predictions, avg(CASE WHEN fp = 0 AND tp = n THEN 1.0 ELSE 0.0 END)::DOUBLE AS exact_match_rate FROM y GROUP BY ALL)"""
_SWC = ("macro_f05", "pair_precision", "pair_recall", "singleton_fp_rate", "avg_predictions", "exact_match_rate")


@query("threshold_sweep", f"WITH {_SWEEP} SELECT threshold::DOUBLE AS threshold, {_r(*_SWC)} FROM sw")
def threshold_sweep(spark, sf_dir):
    return _rounded(evaluate.sweep(_s1(spark, sf_dir), scored(spark, sf_dir).withColumn("score", F.round("score", 9)), truth_pairs(records(spark, sf_dir)), _GRID), _SWC)


@query("best_threshold", f"WITH {_SWEEP} SELECT threshold::DOUBLE AS threshold, round(macro_f05, 6) AS macro_f05 FROM sw ORDER BY round(macro_f05, 9) DESC, threshold LIMIT 1")
def best_threshold(spark, sf_dir):
    """Ties go to the lowest threshold."""
    s = threshold_sweep(spark, sf_dir)
    best = F.max(F.struct("macro_f05", (-F.col("threshold")).alias("neg")))
    return s.agg(best.alias("b")).select((-F.col("b.neg")).alias("threshold"), F.col("b.macro_f05").alias("macro_f05"))


_CURVE = f"""{SCORED}, v AS (SELECT score, sum(label) AS pos, count(*) AS n FROM (SELECT label, round(score, 6) AS score FROM s) GROUP BY score), cv AS (SELECT score, sum(pos) OVER w AS tp, sum(n - pos) OVER w AS fp, sum(pos) OVER () AS positives FROM v WINDOW w AS (ORDER BY score DESC))"""


def _curve_rows(spark, sf_dir):
    return scored(spark, sf_dir).select(F.round("score", 6).alias("score"), "label")


@query("pr_best_f1", f"WITH {_CURVE} SELECT score AS threshold, round(tp / (tp + fp), 6)::DOUBLE AS precision, round(tp / positives, 6)::DOUBLE AS recall, round(2 * tp / (tp + fp + positives), 6)::DOUBLE AS f1 FROM cv WHERE tp > 0 ORDER BY 2 * tp / (tp + fp + positives) DESC, score DESC LIMIT 1")
def pr_best_f1(spark, sf_dir):
    return _rounded(evaluate.best_f1(_curve_rows(spark, sf_dir)), ("precision", "recall", "f1"))


@query(
    "avg_precision",
    f"WITH {_CURVE}, st AS (SELECT *, coalesce(lag(tp) OVER (ORDER BY score DESC), 0) AS tp0, coalesce(lag(fp) OVER (ORDER BY score DESC), 0) AS fp0 FROM cv) SELECT coalesce(round(sum((tp - tp0) / nullif(positives, 0) * tp / (tp + fp)), 6), 0)::DOUBLE AS average_precision, coalesce(round(sum((fp - fp0) * (tp + tp0) / 2.0) / nullif(max(positives) * max(fp), 0), 6), 0)::DOUBLE AS roc_auc FROM st",
)
def avg_precision(spark, sf_dir):
    return _rounded(evaluate.average_precision(_curve_rows(spark, sf_dir)), ("average_precision", "roc_auc"))


@query(
    "metrics_at_thresholds",
    f"WITH {SCORED}, a AS (SELECT t AS threshold, count(*) FILTER (round(score, 6) >= t AND label = 1) AS tp, count(*) FILTER (round(score, 6) >= t AND label = 0) AS fp, sum(label) AS pos FROM s, (SELECT unnest({_GRID})::DOUBLE AS t) GROUP BY ALL) SELECT threshold, round(coalesce(tp / nullif(tp + fp, 0), 0), 6)::DOUBLE AS precision, round(coalesce(tp / nullif(pos, 0), 0), 6)::DOUBLE AS recall, round(coalesce(2 * tp / nullif(tp + fp + pos, 0), 0), 6)::DOUBLE AS f1 FROM a",
)
def metrics_at_thresholds(spark, sf_dir):
    return _rounded(evaluate.at_thresholds(_curve_rows(spark, sf_dir), _GRID), ("precision", "recall", "f1"))
