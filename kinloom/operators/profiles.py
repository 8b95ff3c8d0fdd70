"""Record profiles: every derived field of a record, computed once and before any join.

``profile_early`` has the fields that the 33 early features need, ``profile_v1`` those of the first feature set, ``profile_v2`` those of the second one,
with the ``train`` or ``serve`` word lists. Missing values are empty strings, never null. Names and
addresses are folded first (v1 decomposes, so that a mark parts a word; v2 drops Latin accents);
``unicode=False`` is for tables known to be ASCII.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinloom.functions import text as X
from kinloom.functions import tokens as T
from kinloom.functions import vocab

KEPT = ("entity_id", "source", "ord")


def _base(records: DataFrame) -> DataFrame:
    keep = [c for c in records.columns if c not in ("business_name", "business_address", "country")]
    filled = lambda c: F.coalesce(F.col(c), F.lit(""))
    return records.select(*keep, filled("business_name").alias("business_name"), filled("business_address").alias("business_address"), X.country("country").alias("country"))


def _folded(c, unicode: bool, mode: str):
    return X.fold(c, mode) if unicode else F.col(c)


def profile_v1(records: DataFrame, unicode: bool = True) -> DataFrame:
    """name, name_words, name_grams, alnum, first, address, address_words, numbers, localities and the raw fields."""
    df = _base(records)
    df = df.withColumns({"name": X.norm_name(X.strip_domain(_folded("business_name", unicode, "nfkd"))), "address": X.norm_name(X.strip_address_prefix(_folded("business_address", unicode, "nfkd")))})
    df = df.withColumns({"name_words": T.structural("name"), "address_words": T.words("address"), "compounds": X.compound_numbers("business_address")})
    return df.withColumns(
        {
            "name_grams": T.trigrams("name"),
            "alnum": F.array_join(T.words("name"), ""),
            "first": T.first_of("name_words", T.words("name")),
            "address_grams": T.trigrams("address"),
            "numbers": F.array_distinct(F.concat("compounds", T.numbers("address_words"))),
            "localities": F.array_distinct(T.localities("address_words", "v1")),
        }
    )


def profile_early(records: DataFrame, unicode: bool = True) -> DataFrame:
    """The early profile: own word lists, addresses compared with their prefixes, the first number as the building."""
    df = _base(records)
    bare = X.strip_domain(F.trim("business_name"), vocab.DOMAIN_ENDS_EARLY, slash=True)
    street = X.strip_address_prefix("business_address")
    df = df.withColumns({"plain": X.fold(bare, "nfkd") if unicode else bare, "whole": _folded("business_address", unicode, "nfkd"), "street": X.fold(street, "nfkd") if unicode else street})
    df = df.withColumns({"name": X.norm_name("plain"), "address": X.norm_name("whole"), "street_words": T.words(X.norm_name("street"))})
    df = df.withColumns({"name_words": T.structural("name", "early", 1), "address_words": T.words("address")})
    df = df.withColumn("listed", F.concat(X.compound_numbers_early("business_address"), T.numbers("street_words")))
    df = df.withColumns(
        {
            "compact": X.compact(F.lower("plain")),
            "first": T.first_of("name_words", T.words("name")),
            "name_grams": T.trigrams("name"),
            "address_grams": T.trigrams("address"),
            "numbers": F.array_distinct("listed"),
            "building": T.first_of("listed"),
            "localities": F.array_distinct(T.localities("street_words", "early", 2)),
        }
    )
    return df.drop("plain", "whole", "street", "street_words", "listed")


def profile_v2(records: DataFrame, words: str = "serve", unicode: bool = True) -> DataFrame:
    """The second profile: names, signatures, address parts, script, lengths and the sets that features compare."""
    df = _base(records)
    plain = X.former_name(X.strip_domain(_folded("business_name", unicode, "latin")))
    df = df.withColumns({"name": X.norm_name(plain), "address": X.norm_address(_folded("business_address", unicode, "latin"), words), "script": X.script_of("business_name", arabic=words == "train")})
    df = df.withColumns({"name_all": T.words("name"), "name_words": T.meaningful("name", words), "address_words": T.words("address"), "compounds": X.compound_numbers("business_address")})
    df = df.withColumn("plain_numbers", T.numbers("address_words"))
    return df.withColumns(
        {
            "compact": X.compact("name"),
            "ocr": X.ocr(X.compact("name")),
            "sig": T.signature("name_words"),
            "first": T.first_of("name_words", "name_all"),
            "last": T.last_of("name_words", "name_all"),
            "name_grams": T.trigrams("name"),
            "chars": T.characters(F.lower("business_name")),
            "address_compact": X.compact("address"),
            "address_grams": T.trigrams("address"),
            "numbers": F.array_distinct(F.concat("compounds", "plain_numbers")),
            "number_sig": T.number_signature(F.concat("compounds", "plain_numbers")),
            "building": T.first_of(T.buildings("plain_numbers")),
            "postal": T.first_of(T.postals("plain_numbers")),
            "localities": T.localities("address_words", words),
        }
    )
