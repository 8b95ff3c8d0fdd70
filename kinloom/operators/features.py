"""Features of candidate pairs: profiles joined to pairs, then one projection of built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinloom.functions import tokens as T
from kinloom.store import large

BASE = (
    "name_exact_match name_char_len_s1 name_char_len_cand name_char_len_diff name_char_len_ratio name_char_sim name_levenshtein_sim name_token_overlap name_token_jaccard name_first_token_sim name_prefix_sim "
    "name_alphanumeric_sim addr_exact_match addr_char_len_diff addr_char_len_ratio addr_char_sim addr_levenshtein_sim addr_token_overlap addr_token_jaccard addr_numeric_overlap addr_numeric_jaccard "
    "addr_house_number_match addr_locality_token_overlap addr_locality_jaccard s1_addr_missing cand_addr_missing country_match name_addr_combined_sim name_addr_harmonic_sim both_strong "
    "name_strong_addr_weak addr_strong_name_weak"
).split()
NAME_MORE = "name_compact_match name_ocr_compact_match name_sig_match name_token_containment name_last_token_sim".split()
ADDRESS_MORE = "addr_compact_match addr_token_containment addr_postal_code_match addr_numeric_sig_match both_addr_missing".split()
SCRIPT_MORE = "same_script script_type_latin script_type_indic script_char_overlap".split()
#: The second set in the order that models read it: 46 features.
V2 = [*BASE, *NAME_MORE, *ADDRESS_MORE, *SCRIPT_MORE]
#: The first set: 34 features.
V1 = [*BASE, "name_token_containment", "num_blocks_matched"]
#: The early set: 33 features.
EARLY = [*BASE, "name_token_containment"]

MISSING = -1.0


def beside(pairs: DataFrame, profiles: DataFrame) -> DataFrame:
    """``pairs`` (s1, target, ...) with the profiles of both as structs ``x`` and ``y``."""
    struct = F.struct(*[F.col(c) for c in profiles.columns if c != "entity_id"])
    one = profiles.filter("source = 'S1'").select(F.col("entity_id").alias("s1"), struct.alias("x"))
    two = profiles.filter("source <> 'S1'").select(F.col("entity_id").alias("target"), struct.alias("y"))
    return pairs.join(large(one), "s1").join(large(two), "target")


def _same(c: str) -> Column:
    return F.when((F.col(f"x.{c}") != "") & (F.col(f"x.{c}") == F.col(f"y.{c}")), 1.0).otherwise(0.0)


def _flag(c: Column) -> Column:
    return F.when(c, 1.0).otherwise(0.0)


def _tri(c: str) -> Column:
    """1 equal, 0 different, -1 if a side is missing."""
    x, y = F.col(f"x.{c}"), F.col(f"y.{c}")
    return F.when((x == "") | (y == ""), MISSING).when(x == y, 1.0).otherwise(0.0)


def _ratio(c: str) -> Column:
    a, b = F.length(f"x.{c}"), F.length(f"y.{c}")
    return F.least(a, b) / F.greatest(a, b, F.lit(1))


def name_features() -> dict[str, Column]:
    a, b = F.length("x.name"), F.length("y.name")
    return {
        "name_exact_match": _same("name"),
        "name_compact_match": _same("compact"),
        "name_ocr_compact_match": _same("ocr"),
        "name_sig_match": _same("sig"),
        "name_char_len_s1": a.cast("double"),
        "name_char_len_cand": b.cast("double"),
        "name_char_len_diff": F.abs(a - b).cast("double"),
        "name_char_len_ratio": _ratio("name"),
        "name_char_sim": T.jaccard("x.name_grams", "y.name_grams"),
        "name_levenshtein_sim": F.when((a == 0) & (b == 0), _same("name")).otherwise(T.edit_similarity("x.name", "y.name", 12, 0.5)),
        "name_token_overlap": T.shared("x.name_words", "y.name_words").cast("double"),
        "name_token_jaccard": T.jaccard("x.name_words", "y.name_words"),
        "name_token_containment": T.containment("x.name_words", "y.name_words"),
        "name_first_token_sim": T.short_similarity("x.first", "y.first"),
        "name_last_token_sim": T.short_similarity("x.last", "y.last"),
        "name_prefix_sim": T.common_prefix("x.name", "y.name") / F.greatest(a, b, F.lit(1)),
        "name_alphanumeric_sim": F.when((F.col("x.compact") == "") | (F.col("y.compact") == ""), 0.0).otherwise(T.edit_similarity("x.compact", "y.compact", 10, 0.4)),
    }


def address_features() -> dict[str, Column]:
    missing = (F.col("x.address") == "") | (F.col("y.address") == "")
    return {
        "addr_exact_match": _same("address"),
        "addr_compact_match": _same("address_compact"),
        "addr_char_len_diff": F.abs(F.length("x.address") - F.length("y.address")).cast("double"),
        "addr_char_len_ratio": F.when(missing, 0.0).otherwise(_ratio("address")),
        "addr_char_sim": T.jaccard("x.address_grams", "y.address_grams"),
        "addr_levenshtein_sim": F.when(missing, 0.0).otherwise(T.edit_similarity("x.address", "y.address", 15, 0.5)),
        "addr_token_overlap": T.shared("x.address_words", "y.address_words").cast("double"),
        "addr_token_jaccard": T.jaccard("x.address_words", "y.address_words"),
        "addr_token_containment": T.containment("x.address_words", "y.address_words"),
        "addr_numeric_overlap": T.shared("x.numbers", "y.numbers").cast("double"),
        "addr_numeric_jaccard": T.jaccard("x.numbers", "y.numbers"),
        "addr_house_number_match": _tri("building"),
        "addr_postal_code_match": _tri("postal"),
        "addr_numeric_sig_match": _tri("number_sig"),
        "addr_locality_token_overlap": T.shared("x.localities", "y.localities").cast("double"),
        "addr_locality_jaccard": T.jaccard("x.localities", "y.localities"),
        "s1_addr_missing": _flag(F.col("x.address") == ""),
        "cand_addr_missing": _flag(F.col("y.address") == ""),
        "both_addr_missing": _flag((F.col("x.address") == "") & (F.col("y.address") == "")),
    }


def script_features() -> dict[str, Column]:
    either = lambda *s: _flag(F.col("x.script").isin(*s) | F.col("y.script").isin(*s))
    return {
        "same_script": _flag(F.col("x.script") == F.col("y.script")),
        "script_type_latin": either("latin"),
        "script_type_indic": either("devanagari", "indic_other"),
        "script_char_overlap": T.jaccard("x.chars", "y.chars"),
        "country_match": _flag(F.col("x.country") == F.col("y.country")),
    }


def cross_features(name: str = "name_char_sim", address: str = "addr_char_sim") -> dict[str, Column]:
    """Features of both similarities, over columns that are already there."""
    n, a = F.col(name), F.col(address)
    return {
        "name_addr_combined_sim": 0.65 * n + 0.35 * a,
        "name_addr_harmonic_sim": F.when(n + a == 0, 0.0).otherwise(2 * n * a / (n + a)),
        "both_strong": _flag((n >= 0.70) & (a >= 0.60)),
        "name_strong_addr_weak": _flag((n >= 0.80) & (a < 0.30)),
        "addr_strong_name_weak": _flag((a >= 0.80) & (n < 0.40)),
    }


def pair_features(both: DataFrame, keep: list[str]) -> DataFrame:
    """All features of ``beside``'s rows, and the columns ``keep``."""
    found = both.select(*keep, *[c.cast("double").alias(k) for k, c in (name_features() | address_features() | script_features()).items()])
    return found.select("*", *[c.cast("double").alias(k) for k, c in cross_features().items()])


def features_v2(pairs: DataFrame, profiles: DataFrame) -> DataFrame:
    """``pairs``' columns and the 46 features."""
    return pair_features(beside(pairs, profiles), pairs.columns).select(*pairs.columns, *V2)


def features_v1(pairs: DataFrame, profiles: DataFrame) -> DataFrame:
    """``pairs``' columns and the 34 features; ``n_blocks`` of the pairs is the last of them."""
    both = pair_features(beside(pairs, profiles), pairs.columns).withColumn("num_blocks_matched", F.col("n_blocks").cast("double"))
    return both.select(*pairs.columns, *V1)


def early_cross_features() -> dict[str, Column]:
    """Features of both similarities as the early set has them: by edit distance, and strong by words or edits."""
    n, a, nw, aw = map(F.col, ("name_levenshtein_sim", "addr_levenshtein_sim", "name_token_jaccard", "addr_token_jaccard"))
    return {
        "name_addr_combined_sim": 0.55 * n + 0.45 * a,
        "name_addr_harmonic_sim": 2.0 * n * a / (n + a + 1e-6),
        "both_strong": _flag(((nw >= 0.5) | (n >= 0.70)) & ((aw >= 0.4) | (a >= 0.60))),
        "name_strong_addr_weak": _flag(((nw >= 0.70) | (n >= 0.80)) & (aw < 0.20) & (a < 0.35)),
        "addr_strong_name_weak": _flag(((aw >= 0.65) | (a >= 0.70)) & (nw < 0.25) & (n < 0.45)),
    }


def features_early(pairs: DataFrame, profiles: DataFrame) -> DataFrame:
    """``pairs``' columns and the 33 early features, over ``profile_early``."""
    missing = (F.col("x.address") == "") | (F.col("y.address") == "")
    own = {
        "name_levenshtein_sim": T.edit_similarity("x.name", "y.name", 12, 0.5),
        "addr_levenshtein_sim": F.when(missing, 0.0).otherwise(T.edit_similarity("x.address", "y.address", 15, 0.4)),
        "country_match": _flag((F.col("x.country") == F.col("y.country")) & (F.col("x.country") != "UNKNOWN")),
    }
    cross = early_cross_features()
    alike = {k: c for k, c in (name_features() | address_features() | own).items() if k in EARLY}
    found = beside(pairs, profiles).select(*pairs.columns, *[c.cast("double").alias(k) for k, c in alike.items()])
    return found.select("*", *[c.cast("double").alias(k) for k, c in cross.items()]).select(*pairs.columns, *EARLY)


def downcast(features: DataFrame, names: list[str]) -> DataFrame:
    """Features as 32-bit floats, as they are stored."""
    return features.select(*[F.col(c).cast("float").alias(c) if c in names else F.col(c) for c in features.columns])


def summary(features: DataFrame, names: list[str]) -> DataFrame:
    """feature, min, mean, median, max, nulls: one aggregation over all columns, then turned to rows."""
    one = features.agg(*[x for c in names for x in (F.min(c).alias(f"{c}__min"), F.avg(c).alias(f"{c}__mean"), F.percentile(c, 0.5).alias(f"{c}__median"), F.max(c).alias(f"{c}__max"), F.count_if(F.col(c).isNull()).alias(f"{c}__nulls"))])
    row = lambda c: F.struct(F.lit(c).alias("feature"), *[F.col(f"{c}__{k}").cast("double").alias(k) for k in ("min", "mean", "median", "max", "nulls")])
    return one.select(F.inline(F.array(*map(row, names))))


def hard_negative_flags(features: DataFrame) -> DataFrame:
    """Add ``hard`` for negatives that look like matches, and ``weight`` 2.5 for them."""
    hard = (F.col("label") == 0) & ((F.col("name_char_sim") >= 0.7) | (F.col("addr_char_sim") >= 0.7) | (F.col("name_exact_match") == 1))
    return features.withColumn("hard", F.when(hard, 1).otherwise(0)).withColumn("weight", F.when(hard, 2.5).otherwise(1.0))


def linear_score() -> Column:
    """A fixed score in [0, 1] that stands in where no trained model is wanted."""
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), 0.50 * F.col("name_char_sim") + 0.20 * F.col("name_token_jaccard") + 0.20 * F.col("addr_char_sim") + 0.10 * F.col("name_exact_match")))
