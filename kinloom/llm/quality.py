r"""Quality rules as a bitmask ledger.

``ledger`` evaluates every rule once and keeps the measurements and one bit per failed rule. Policies
are versioned sets of rule bits, applied to the stored bits; ``ablations`` counts by bitwise
aggregation what each rule of a policy removes alone and together with others. All is built from
SQL functions; each row is measured by itself, so nothing is shuffled.

Words are ``[^\x20\x09-\x0D]+``. Defined results: a null text counts as one without words and fails
``few_words``; repeated rows are judged one by one; a word window is counted by its exact words.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPACE = r"[ \t-\r]+"
SPACES = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"

# Rule name -> SQL over the measurements. The position is the rule's bit; append, never reorder.
RULES: tuple[tuple[str, str], ...] = (
    ("few_words", "n_words < 10"),
    ("repeated_windows", "100 * n_repeat_words > 20 * n_words"),
    ("repeated_lines", "100 * n_dup_lines > 50 * n_lines"),
    ("symbols", "n_symbols > n_words"),
    ("word_length", "word_chars > 20 * n_words"),
)
MEASURES = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words")
BIT = {name: 1 << i for i, (name, _) in enumerate(RULES)}

# Policy version -> names of the rules that reject a document.
POLICIES: dict[str, tuple[str, ...]] = {
    "base": ("few_words", "repeated_windows"),
    "v1": ("few_words", "repeated_windows", "repeated_lines", "symbols", "word_length"),
}
CURRENT = "v1"
BASE = "base"


def policy_mask(version: str) -> int:
    return sum(BIT[name] for name in POLICIES[version])



def measure(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with n_words, word_chars, n_symbols, n_lines, n_dup_lines and n_repeat_words (long).

    Columns of the same names are replaced. A document's arrays live and end inside its own row.
    """
    rest = [F.col(f"`{c}`") for c in docs.columns if c not in MEASURES]
    t, words, lines, windows, places, at = (f"__quality_{k}" for k in ("text", "words", "lines", "windows", "places", "at"))
    df = docs.select(*rest, F.coalesce(F.col(text), F.lit("")).alias(t))
    df = df.withColumns({words: F.array_remove(F.split(t, SPACE), ""), lines: F.filter(F.split(t, "\n"), lambda x: x.rlike(r"[^ \t-\r]"))})
    # A window is its exact five words, joined by a space, which no word has.
    shifted = ", ".join(f"slice({words}, {k}, greatest(size({words}) - 4, 0))" for k in range(1, 6))
    df = df.withColumn(windows, F.expr(f"transform(arrays_zip({shifted}), x -> concat_ws(' ', x['0'], x['1'], x['2'], x['3'], x['4']))"))
    # Only a text with a repeated window sorts them: sorted with their places, equal ones are neighbours.
    repeated = F.size(F.array_distinct(windows)) < F.size(windows)
    df = df.withColumn(places, F.when(repeated, F.expr(f"array_sort(arrays_zip({windows}, sequence(0, size({windows}) - 1)))")))
    pairs = f"filter(arrays_zip(slice({places}, 1, size({places}) - 1), slice({places}, 2, size({places}) - 1)), p -> p['0'].{windows} = p['1'].{windows})"
    df = df.withColumn(at, F.when(repeated, F.expr(f"array_sort(array_distinct(flatten(transform({pairs}, p -> array(p['0']['1'], p['1']['1'])))))")))
    # Windows at places p < q cover min(5, q - p) words from p on; the last covers five.
    covered = F.expr(f"5L + aggregate(arrays_zip(slice({at}, 1, size({at}) - 1), slice({at}, 2, size({at}) - 1)), 0L, (n, p) -> n + least(5, p['1'] - p['0']))")
    found = F.struct(
        F.size(words).cast("long").alias("n_words"),
        F.length(F.translate(t, SPACES, "")).cast("long").alias("word_chars"),
        (F.length(t) - F.length(F.translate(t, SYMBOLS, ""))).cast("long").alias("n_symbols"),
        F.size(lines).cast("long").alias("n_lines"),
        (F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias("n_dup_lines"),
        F.when(F.col(at).isNotNull(), covered).otherwise(F.lit(0)).cast("long").alias("n_repeat_words"),
    )
    # A generator of one row: a filter on a measurement isn't pushed below it, where each use would measure anew.
    return df.select(*rest, F.inline(F.array(found)))


def ledger(docs: DataFrame, text: str = "text") -> DataFrame:
    """``measure`` and ``fail_bits``: bit i is set if rule i of RULES fails."""
    bits = " + ".join(f"CASE WHEN {sql} THEN {BIT[name]} ELSE 0 END" for name, sql in RULES)
    return measure(docs, text).withColumn("fail_bits", F.expr(f"cast({bits} AS int)"))


def fails(version: str) -> Column:
    """Whether a ledger row fails a rule of the policy."""
    return F.col("fail_bits").bitwiseAND(F.lit(policy_mask(version))) != 0


def with_policy(entries: DataFrame, version: str = CURRENT, name: str = "kept") -> DataFrame:
    return entries.withColumn(name, ~fails(version))


def ablations(entries: DataFrame) -> DataFrame:
    """Per policy and rule: documents the rule fails, those that only it rejects, and those that one policy rejects.

    The ledger is first counted by its bits, at most 2 ** rules rows; everything else is bit arithmetic on those.
    """
    counts = entries.groupBy("fail_bits").agg(F.count("*").alias("n"))
    rows = [(v, name, BIT[name], policy_mask(v)) for v, names in POLICIES.items() for name in names]
    policies = entries.sparkSession.createDataFrame(rows, "policy string, rule string, bit int, mask int")
    # A constant key: a few policy rows against a few counted rows.
    both = counts.withColumn("one", F.lit(1)).join(F.broadcast(policies.withColumn("one", F.lit(1))), "one")
    hit = F.col("fail_bits").bitwiseAND(F.col("mask"))
    total = lambda when: F.sum(F.when(when, F.col("n")).otherwise(0)).cast("long")
    return both.groupBy("policy", "rule").agg(total(hit.bitwiseAND(F.col("bit")) != 0).alias("n_failed"), total(hit == F.col("bit")).alias("n_only_this"), total(hit != 0).alias("n_rejected"))


def op3(spark, sf_dir: str) -> DataFrame:
    from kinloom.llm.tables import table

    entries = with_policy(ledger(table(spark, sf_dir, "documents").select("doc_id", "text")).withColumn("base_failed", fails(BASE)))
    return entries.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_lines", "fail_bits")


SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l
  FROM documents
), win AS (
  SELECT doc_id, i, array_to_string(w[i:i + 4], ' ') AS five FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM d)
), dup AS (
  SELECT doc_id, i FROM win QUALIFY count(*) OVER (PARTITION BY doc_id, five) > 1
), hit AS (
  SELECT doc_id, count(DISTINCT i + k) AS n FROM dup, range(0, 5) r(k) GROUP BY doc_id
), m AS (
  SELECT doc_id, len(w)::BIGINT AS n_words, length(translate(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13), ''))::BIGINT AS word_chars,
         (length(text) - length(translate(text, '#*$%&|<>', '')))::BIGINT AS n_symbols, (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines,
         coalesce(n, 0)::BIGINT AS n_repeat_words, len(l)::BIGINT AS n_lines
  FROM d LEFT JOIN hit USING (doc_id)
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines,
       (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AS base_failed,
       NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words OR 100 * n_dup_lines > 50 * n_lines OR n_symbols > n_words OR word_chars > 20 * n_words) AS kept,
       (CASE WHEN n_words < 10 THEN 1 ELSE 0 END + CASE WHEN 100 * n_repeat_words > 20 * n_words THEN 2 ELSE 0 END + CASE WHEN 100 * n_dup_lines > 50 * n_lines THEN 4 ELSE 0 END
        + CASE WHEN n_symbols > n_words THEN 8 ELSE 0 END + CASE WHEN word_chars > 20 * n_words THEN 16 ELSE 0 END)::INTEGER AS fail_bits
FROM m
"""
