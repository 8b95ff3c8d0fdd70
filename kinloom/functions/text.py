"""Scalar text functions as Spark columns. All but ``fold`` run inside the JVM.

Character classes are spelt ``[^\\p{L}\\p{N}_\\s]`` so that they mean the same in Java and in RE2;
combining marks count as punctuation.
"""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from kinloom.functions import vocab


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def squeeze(x: Column) -> Column:
    return F.trim(F.regexp_replace(x, r"\s+", " "))


def norm_name(x) -> Column:
    """Punctuation to spaces, lower case, single spaces."""
    return squeeze(F.lower(F.regexp_replace(_c(x), r"[^\p{L}\p{N}_\s]", " ")))


def _folded(mode: str):
    def one(s: str | None) -> str | None:
        if s is None or s.isascii():
            return s
        d = unicodedata.normalize("NFKD", s)
        if mode == "nfkd":
            return d
        if mode == "latin":  # keep other scripts' marks
            return unicodedata.normalize("NFKC", "".join(c for c in d if not "̀" <= c <= "ͯ"))
        return "".join(c for c in d if not unicodedata.combining(c))

    @F.pandas_udf("string")
    def run(batch: pd.Series) -> pd.Series:
        return batch.map(one)

    return run


def fold(x, mode: str = "latin") -> Column:
    """Unicode folding, which Spark has no function for: an Arrow UDF.

    ``nfkd`` decomposes, ``latin`` drops Latin accents and recomposes, ``marks`` drops all marks.
    """
    return _folded(mode)(_c(x))


def clean_fast(x) -> Column:
    """Lower case, everything but a-z, 0-9 and space to a space, ends trimmed; inner runs of spaces stay."""
    return F.trim(F.regexp_replace(F.lower(_c(x)), r"[^a-z0-9 ]", " "))


def strip_domain(x, ends=tuple(vocab.DOMAIN_ENDS), slash: bool = False) -> Column:
    """Without scheme, ``www.`` and the domain's end with any path; text without a dot and www (and, with ``slash``, a slash) stays."""
    x = _c(x)
    ends = [e.replace(".", r"\.") for e in ends]
    inner = F.regexp_replace(x, r"(?i)^(?:https?://)?(?:www\.)?", "")
    inner = F.regexp_replace(inner, rf"(?i)\.(?:{'|'.join(ends)})(?:/.*)?$", "")
    return F.when(F.instr(x, ".").eqNullSafe(0) & (F.instr(F.lower(x), "www") == 0) & (F.lit(not slash) | (F.instr(x, "/") == 0)), x).otherwise(inner)


def domain_words(x) -> Column:
    """Camel case words and numbers of a domain of two or more characters, lower-cased, without stopwords."""
    found = F.regexp_extract_all(_c(x), F.lit(r"[A-Z]?[a-z]+|[A-Z]+(?=[A-Z][a-z]|\b)|\d+"), F.lit(0))
    stop = F.array(*map(F.lit, vocab.STOPWORDS["base"]))
    return F.filter(F.transform(found, F.lower), lambda t: (F.length(t) >= 2) & ~F.array_contains(stop, t))


def norm_number(x) -> Column:
    """A numeral without leading zeros; ``000`` is ``0``; other text stays."""
    x = _c(x)
    return F.when(x.rlike(r"^\p{Nd}+$"), F.coalesce(F.nullif(F.ltrim(x, F.lit("0")), F.lit("")), F.lit("0"))).otherwise(x)


def compound_numbers(x) -> Column:
    """``12/034`` and the like as ``12_34``."""
    found = F.regexp_extract_all(_c(x), F.lit(r"\b(\d+[/_-]\d+)\b"), F.lit(1))
    return F.transform(found, lambda t: F.array_join(F.transform(F.split(t, r"[/_-]"), norm_number), "_"))


def compound_numbers_early(x) -> Column:
    """``12/034A`` and the like as ``12/034A``, ``010-2`` as ``10/2``; only of text with a slash or a hyphen."""
    x = _c(x)
    found = F.regexp_extract_all(x, F.lit(r"\b(\d+[/_-]\d+[a-zA-Z]?)\b"), F.lit(1))
    return F.when(x.rlike("[/-]"), F.transform(found, lambda t: F.array_join(F.transform(F.split(t, r"[/_-]"), norm_number), "/"))).otherwise(F.array().cast("array<string>"))


def strip_address_prefix(x, french: bool = False) -> Column:
    return F.regexp_replace(_c(x), "(?i)" + (vocab.ADDRESS_PREFIX_FRENCH if french else vocab.ADDRESS_PREFIX), " ")


def lookup(words: dict[str, str], t: Column) -> Column:
    table = F.create_map(*[F.lit(v) for kv in words.items() for v in kv])
    return F.coalesce(table[t], t)


def norm_address(x, words: str = "serve") -> Column:
    """Prefixes removed, punctuation to spaces, abbreviations spelt out, numerals without leading zeros."""
    plain = squeeze(F.regexp_replace(strip_address_prefix(F.lower(_c(x)), french=True), r"[^\p{L}\p{N}_\s]", " "))
    tokens = F.filter(F.split(plain, " "), lambda t: t != "")
    return F.array_join(F.transform(tokens, lambda t: norm_number(lookup(vocab.ABBREVIATIONS[words], t))), " ")


def former_name(x) -> Column:
    """What follows "formerly", "aka" and the like, if it has more than three characters."""
    x = _c(x)
    found = F.trim(F.regexp_extract(x, "(?i)" + vocab.FORMER_NAME, 1))
    return F.when(F.length(found) > 3, found).otherwise(x)


def script_of(x, arabic: bool = True) -> Column:
    """The script of the first Indic or Arabic character, else latin, other or none."""
    x = _c(x)
    first = F.regexp_extract(x, "([ऀ-ൿ" + ("؀-ۿ" if arabic else "") + "])", 1)
    return (
        F.when(F.coalesce(x, F.lit("")) == "", "none")
        .when(first.rlike("[ऀ-ॿ]"), "devanagari")
        .when(first.rlike("[ঀ-ൿ]"), "indic_other")
        .when(first.rlike("[؀-ۿ]"), "arabic")
        .when(x.rlike("[A-Za-zÀ-ɏ]"), "latin")
        .otherwise("other")
    )


def query_script(x) -> Column:
    """tamil or hindi by the number of their characters, else latin."""
    x = F.coalesce(_c(x), F.lit(""))
    tamil, hindi = (F.length(F.regexp_replace(x, f"[^{r}]", "")) for r in ("஀-௿", "ऀ-ॿ"))
    return F.when((tamil > 0) & (tamil >= hindi), "tamil").when(hindi > tamil, "hindi").otherwise("latin")


def compact(x) -> Column:
    return F.regexp_replace(_c(x), r"[^\p{L}\p{N}]", "")


def ocr(x) -> Column:
    """Digits that stand for letters in scanned names."""
    return F.translate(_c(x), vocab.OCR_FROM, vocab.OCR_TO)


def country(x, missing: str = "UNKNOWN") -> Column:
    canon = F.upper(F.trim(_c(x)))
    return F.when(F.coalesce(canon, F.lit("")) == "", missing).otherwise(canon)


def category(name, address) -> Column:
    text = F.concat(_c(name), F.lit(" "), _c(address))
    out = None
    for label, words in vocab.CATEGORIES:
        hit = text.rlike(rf"(?i)\b({'|'.join(words.split())})\b")
        out = F.when(hit, label) if out is None else out.when(hit, label)
    return out.otherwise(vocab.DEFAULT_CATEGORY)


def building(address) -> Column:
    return F.regexp_extract(_c(address), "(?i)" + vocab.BUILDING, 1)


def landmark(address) -> Column:
    return F.trim(F.regexp_extract(_c(address), "(?i)" + vocab.LANDMARK, 1))


def locality(address) -> Column:
    """The last part but one between commas."""
    parts = F.filter(F.transform(F.split(_c(address), ","), lambda p: F.trim(p)), lambda p: p != "")
    return F.when(F.size(parts) >= 2, F.element_at(parts, -2)).otherwise("")


def coordinates(address, country_name) -> Column:
    """(lat, lng) of the first listed place in the address, else of the country, else zeros; a null address is in no place."""
    low = F.lower(F.coalesce(_c(address), F.lit("")))
    pair = lambda a, b: F.struct(F.lit(a).alias("lat"), F.lit(b).alias("lng"))
    listed = F.array(*[F.struct(F.lit(place).alias("place"), pair(lat, lng).alias("at")) for place, lat, lng in vocab.PLACES])
    centre = None
    for name, lat, lng in vocab.COUNTRY_CENTRES:
        centre = (F if centre is None else centre).when(_c(country_name) == name, pair(lat, lng))
    # The table is one constant that the search runs over, not a branch of code for each place.
    return F.coalesce(F.try_element_at(F.filter(listed, lambda p: F.contains(low, p["place"])), F.lit(1))["at"], centre, pair(0.0, 0.0))


def fix_typos(x) -> Column:
    words = F.filter(F.split(_c(x), r"\s+"), lambda t: t != "")
    return F.array_join(F.transform(words, lambda t: F.coalesce(F.create_map(*[F.lit(v) for kv in vocab.TYPOS.items() for v in kv])[F.lower(t)], t)), " ")


def human_size(n) -> Column:
    """Bytes as B, KB, MB, GB or TB."""
    n, out = _c(n).cast("double"), None
    for i, unit in enumerate(("B", "KB", "MB", "GB")):
        out = (F if out is None else out).when(n < 1024.0 ** (i + 1), F.concat(F.format_string("%.2f", F.round(n / 1024.0**i, 2)), F.lit(" " + unit)))
    return out.otherwise(F.concat(F.format_string("%.2f", F.round(n / 1024.0**4, 2)), F.lit(" TB")))


def shorten(x, n: int) -> Column:
    x = _c(x)
    return F.when(F.length(x) > n, F.concat(F.substring(x, 1, n), F.lit("..."))).otherwise(x)
