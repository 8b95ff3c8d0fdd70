"""Queries of the text and token functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from kinloom.functions import text as X
from kinloom.functions import tokens as T
from kinloom.functions import vocab
from kinloom.plans import duck as D
from kinloom.plans.registry import query
from kinloom.plans.views import records, table

NAME, ADDRESS = "business_name", "business_address"


def _over(name: str, sql: str, *columns: str, messy: bool = True):
    """Register a query that adds columns to the records."""

    def add(f):
        def run(spark, sf_dir):
            return records(spark, sf_dir, messy).select("entity_id", *f())

        query(name, f"WITH {D.rec(messy)} SELECT entity_id, {sql} FROM rec")(run)
        return f

    return add


@_over("norm_name_ascii", f"{D.norm(NAME)} AS name, {D.norm(ADDRESS)} AS address")
def _():
    return X.norm_name(NAME).alias("name"), X.norm_name(ADDRESS).alias("address")


@_over("clean_fast", f"trim(regexp_replace(lower({NAME}), '[^a-z0-9 ]', ' ', 'g')) AS name")
def _():
    return (X.clean_fast(NAME).alias("name"),)


@_over("strip_domain", f"{D.domain(NAME)} AS name")
def _():
    return (X.strip_domain(NAME).alias("name"),)


@_over("norm_numeric", f"list_transform({D.words(D.norm(ADDRESS))}, lambda t: {D.number('t')}) AS tokens")
def _():
    return (F.transform(T.words(X.norm_name(ADDRESS)), X.norm_number).alias("tokens"),)


@_over("compound_numbers", f"{D.compounds(ADDRESS)} AS compounds")
def _():
    return (X.compound_numbers(ADDRESS).alias("compounds"),)


@_over("address_prefix_strip", f"regexp_replace({ADDRESS}, {D.q(vocab.ADDRESS_PREFIX)}, ' ', 'gi') AS address")
def _():
    return (X.strip_address_prefix(ADDRESS).alias("address"),)


@_over("address_expand", f"{D.address(ADDRESS)} AS served, {D.address(ADDRESS, 'train')} AS trained")
def _():
    return X.norm_address(ADDRESS).alias("served"), X.norm_address(ADDRESS, "train").alias("trained")


@_over("former_name", f"CASE WHEN length(trim(regexp_extract({NAME}, {D.q(vocab.FORMER_NAME)}, 1, 'i'))) > 3 THEN trim(regexp_extract({NAME}, {D.q(vocab.FORMER_NAME)}, 1, 'i')) ELSE {NAME} END AS name")
def _():
    return (X.former_name(NAME).alias("name"),)


_FIRST = r"regexp_extract(text, '([\x{0600}-\x{06FF}\x{0900}-\x{0D7F}])', 1)"


@query(
    "detect_script",
    rf"""SELECT doc_id, CASE WHEN coalesce(text, '') = '' THEN 'none' WHEN {_FIRST} <> '' THEN CASE WHEN unicode({_FIRST}) BETWEEN 2304 AND 2431 THEN 'devanagari' WHEN unicode({_FIRST}) >= 2432 THEN 'indic_other' ELSE 'arabic' END
    WHEN regexp_matches(text, '[A-Za-z\x{{00C0}}-\x{{024F}}]') THEN 'latin' ELSE 'other' END AS script FROM documents""",
)
def detect_script(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", X.script_of("text").alias("script"))


@query(
    "query_script",
    r"""WITH s AS (SELECT item_id, length(regexp_replace(text, '[^\x{0B80}-\x{0BFF}]', '', 'g')) AS ta, length(regexp_replace(text, '[^\x{0900}-\x{097F}]', '', 'g')) AS hi FROM benchmark)
    SELECT item_id, CASE WHEN ta > 0 AND ta >= hi THEN 'tamil' WHEN hi > ta THEN 'hindi' ELSE 'latin' END AS script FROM s""",
)
def query_script(spark, sf_dir):
    return table(spark, sf_dir, "benchmark").select("item_id", X.query_script("text").alias("script"))


@_over("compact_ocr", rf"regexp_replace({D.norm(NAME)}, '[^\p{{L}}\p{{N}}]', '', 'g') AS compact, translate(regexp_replace({D.norm(NAME)}, '[^\p{{L}}\p{{N}}]', '', 'g'), '01358@$', 'olesbas') AS ocr")
def _():
    c = X.compact(X.norm_name(NAME))
    return c.alias("compact"), X.ocr(c).alias("ocr")


@_over("country_canon", f"{D.country('country')} AS canon, {D.country(ADDRESS)} AS missing")
def _():
    return X.country("country").alias("canon"), X.country(ADDRESS).alias("missing")


CASES = " ".join(f"WHEN regexp_matches(concat({NAME}, ' ', {ADDRESS}), '(?i)\\b({'|'.join(w.split())})\\b') THEN '{label}'" for label, w in vocab.CATEGORIES)


@_over("infer_category", f"CASE {CASES} ELSE '{vocab.DEFAULT_CATEGORY}' END AS category")
def _():
    return (X.category(NAME, ADDRESS).alias("category"),)


_PARTS = f"list_filter(list_transform(string_split({ADDRESS}, ','), lambda p: trim(p)), lambda p: p <> '')"


@_over(
    "building_landmark_locality",
    f"regexp_extract({ADDRESS}, {D.q(vocab.BUILDING)}, 1, 'i') AS building, trim(regexp_extract({ADDRESS}, {D.q(vocab.LANDMARK)}, 1, 'i')) AS landmark, CASE WHEN len({_PARTS}) >= 2 THEN {_PARTS}[-2] ELSE '' END AS locality",
)
def _():
    return X.building(ADDRESS).alias("building"), X.landmark(ADDRESS).alias("landmark"), X.locality(ADDRESS).alias("locality")


_WHERE = " ".join(f"WHEN contains(lower({ADDRESS}), {D.q(p)}) THEN {{}}" for p, _, _ in vocab.PLACES)
_LAT = _WHERE.format(*[repr(a) for _, a, _ in vocab.PLACES]) + "".join(f" WHEN country = '{n}' THEN {a}" for n, a, _ in vocab.COUNTRY_CENTRES)
_LNG = _WHERE.format(*[repr(b) for _, _, b in vocab.PLACES]) + "".join(f" WHEN country = '{n}' THEN {b}" for n, _, b in vocab.COUNTRY_CENTRES)


@_over("estimate_coords", f"(CASE {_LAT} ELSE 0.0 END)::DOUBLE AS lat, (CASE {_LNG} ELSE 0.0 END)::DOUBLE AS lng")
def _():
    at = X.coordinates(ADDRESS, "country")
    return at["lat"].alias("lat"), at["lng"].alias("lng")


_FIX = "MAP {" + ", ".join(f"{D.q(k)}: {D.q(v)}" for k, v in vocab.TYPOS.items()) + "}"


@_over("typo_correct", f"array_to_string(list_transform({D.words(f'''concat({NAME}, ' Resturant clg banglore')''')}, lambda t: coalesce({_FIX}[lower(t)], t)), ' ') AS fixed")
def _():
    return (X.fix_typos(F.concat(NAME, F.lit(" Resturant clg banglore"))).alias("fixed"),)


@query("nfkd_fold")
def nfkd_fold(spark, sf_dir):
    """Arrow UDF: the foldings of each document's whole text."""
    return table(spark, sf_dir, "documents").select("doc_id", X.norm_name(X.fold("text", "nfkd")).alias("v1"), X.norm_name(X.fold("text", "latin")).alias("v2"), F.lower(X.fold("text", "marks")).alias("unmarked"))


@query("domain_split")
def domain_split(spark, sf_dir):
    """The pattern needs look-ahead, which the oracle's regex engine lacks."""
    return table(spark, sf_dir, "pages").select("page_id", X.domain_words(X.strip_domain("url")).alias("words"))


@query("display_text", "SELECT doc_id, CASE WHEN length(text) > 60 THEN concat(substr(text, 1, 60), '...') ELSE text END AS shown, CASE WHEN n_chars < 1024 THEN concat(printf('%.2f', round(n_chars::DOUBLE, 2)), ' B') WHEN n_chars < 1048576 THEN concat(printf('%.2f', round(n_chars / 1024.0::DOUBLE, 2)), ' KB') ELSE concat(printf('%.2f', round(n_chars / 1048576.0::DOUBLE, 2)), ' MB') END AS size FROM documents")
def display_text(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", X.shorten("text", 60).alias("shown"), X.human_size("n_chars").alias("size"))


@_over("name_tokens", f"{D.name_words(D.norm(NAME))} AS tokens, CASE WHEN len(b) = 0 THEN a ELSE b END AS significant FROM (SELECT *, list_filter({D.words(D.norm(NAME))}, lambda t: NOT list_contains({D.listed(vocab.STOPWORDS['base'])}, t)) AS a, list_filter({D.words(D.norm(NAME))}, lambda t: NOT list_contains({D.listed([*vocab.STOPWORDS['base'], *vocab.SUFFIXES['base']])}, t)) AS b FROM rec) AS rec --")
def _():
    n = X.norm_name(NAME)
    return T.name_words(n).alias("tokens"), T.significant(n).alias("significant")


@_over("meaningful_tokens", f"{D.meaningful(D.norm(NAME))} AS served, {D.meaningful(D.norm(NAME), 'train')} AS trained")
def _():
    n = X.norm_name(NAME)
    return T.meaningful(n).alias("served"), T.meaningful(n, "train").alias("trained")


_BAD = D.listed([*vocab.PREFIXES["v1"], *vocab.STOPWORDS["v1"]])
_END = D.listed([*vocab.SUFFIXES["v1"], *vocab.STOPWORDS["v1"]])
_ALL = D.listed([*vocab.PREFIXES["v1"], *vocab.STOPWORDS["v1"], *vocab.SUFFIXES["v1"]])


@_over(
    "structural_tokens",
    f"""CASE WHEN len(k) = 0 THEN t ELSE k END AS tokens FROM (SELECT *, list_filter(t, lambda x: NOT list_contains({_ALL}, x) AND length(x) >= 2) AS k FROM (SELECT *, CASE WHEN a IS NULL OR b IS NULL OR b < a THEN [] ELSE w[a:b] END AS t
    FROM (SELECT *, list_min(list_filter(range(1, len(w) + 1), lambda i: NOT list_contains({_BAD}, w[i]))) AS a, list_max(list_filter(range(1, len(w) + 1), lambda i: NOT list_contains({_END}, w[i]))) AS b
    FROM (SELECT *, {D.words(D.norm(NAME))} AS w FROM rec)))) AS rec --""",
)
def _():
    return (T.structural(X.norm_name(NAME)).alias("tokens"),)


_TOK = f"string_split({D.address(ADDRESS)}, ' ')"


@_over("address_split", f"{D.numbers(_TOK)} AS numbers, list_filter({D.numbers(_TOK)}, lambda t: length(t) IN (5, 6)) AS postals, list_filter({D.numbers(_TOK)}, lambda t: length(t) <= 4) AS buildings, {D.localities(_TOK)} AS localities")
def _():
    t = F.split(X.norm_address(ADDRESS), " ")
    return T.numbers(t).alias("numbers"), T.postals(t).alias("postals"), T.buildings(t).alias("buildings"), T.localities(t).alias("localities")


_M = D.meaningful(D.norm(NAME))


@_over("token_signature", f"array_to_string(list_sort(list_distinct({_M})), '_') AS signature, coalesce(({_M})[1], '') AS first, coalesce(({_M})[-1], '') AS last")
def _():
    m = T.meaningful(X.norm_name(NAME))
    return T.signature(m).alias("signature"), T.first_of(m).alias("first"), T.last_of(m).alias("last")


@_over("numeric_signature", f"array_to_string(({D.numbers(_TOK)})[1:4], '_') AS signature")
def _():
    return (T.number_signature(T.numbers(F.split(X.norm_address(ADDRESS), " "))).alias("signature"),)


@_over("trigrams", f"list_sort({D.trigrams(D.norm(NAME))}) AS grams")
def _():
    return (F.array_sort(T.trigrams(X.norm_name(NAME))).alias("grams"),)


@query("parse_id_list", r"""SELECT event_id, list_filter(list_transform(string_split(regexp_replace(props, '[\[\]''"]', '', 'g'), ','), lambda t: trim(t)), lambda t: t <> '') AS ids FROM events""")
def parse_id_list(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", T.parse_ids("props").alias("ids"))


@_over("distinct_in_order", f"{D.distinct(D.words(D.norm(f'''concat({NAME}, ' ', {NAME}, ' ', {ADDRESS})''')))} AS tokens")
def _():
    return (T.distinct_in_order(T.words(X.norm_name(F.concat_ws(" ", NAME, NAME, ADDRESS)))).alias("tokens"),)


# Pair functions run over each record beside the next one of its brand in order.
_PAIR = f"""{D.rec()}, pair AS (SELECT entity_id, {D.norm(NAME)} AS a, lead({D.norm(NAME)}) OVER (PARTITION BY country ORDER BY ord) AS b, {NAME} AS x, lead({NAME}) OVER (PARTITION BY country ORDER BY ord) AS y FROM rec)"""


def _pairs(name: str, sql: str):
    def add(f):
        def run(spark, sf_dir):
            from pyspark.sql import Window

            w = Window.partitionBy("country").orderBy("ord")
            n = records(spark, sf_dir).select("entity_id", "country", "ord", X.norm_name(NAME).alias("a"), F.col(NAME).alias("x"))
            both = n.select("entity_id", "a", "x", F.lead("a").over(w).alias("b"), F.lead("x").over(w).alias("y")).filter("b IS NOT NULL")
            return both.select("entity_id", *f())

        query(name, f"WITH {_PAIR} SELECT entity_id, {sql} FROM pair WHERE b IS NOT NULL")(run)
        return f

    return add


_r = lambda sql: f"round({sql}, 6)"
_R = lambda c, name: F.round(c, 6).alias(name)
_WA, _WB = D.words("a"), D.words("b")


@_pairs("jaccard", f"{_r(D.jaccard(_WA, _WB))} AS words, {_r(D.jaccard(f'({D.trigrams("a")})', f'({D.trigrams("b")})'))} AS grams")
def _():
    return _R(T.jaccard(T.words("a"), T.words("b")), "words"), _R(T.jaccard(T.trigrams("a"), T.trigrams("b")), "grams")


@_pairs("containment", f"{_r(D.containment(_WA, _WB))} AS words, {D.shared(_WA, _WB)} AS shared")
def _():
    return _R(T.containment(T.words("a"), T.words("b")), "words"), T.shared(T.words("a"), T.words("b")).alias("shared")


@_pairs("lcp", f"{D.prefix('a', 'b')} AS n")
def _():
    return (T.common_prefix("a", "b").alias("n"),)


@_pairs("bounded_levenshtein", f"{D.capped('a', 'b', '4')} AS near, {_r(D.edit('a', 'b', 12, 0.5))} AS similarity")
def _():
    return T.bounded_levenshtein("a", "b", 4).alias("near"), _R(T.edit_similarity("a", "b", 12, 0.5), "similarity")


_CHARS = lambda x: f"list_distinct(string_split({x}, ''))"


@_pairs("char_overlap", f"{_r(D.jaccard(_CHARS('x'), _CHARS('y')))} AS overlap")
def _():
    return (_R(T.jaccard(T.characters("x"), T.characters("y")), "overlap"),)


@_pairs("string_similarity", f"{_r(D.similarity('x', 'y'))} AS similarity")
def _():
    return (_R(T.text_similarity("x", "y"), "similarity"),)
