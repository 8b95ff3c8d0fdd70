r"""Secret scan: candidates by pattern, false positives removed by a random forest.

Candidates are runs of 12 or more key characters with a digit, values of 6 or more characters after a
secret word and ``=`` or ``:``, and private key blocks (one that nothing ends is its head and the key
characters after it). Each has features: length, transitions between
kinds of characters, shares of digits, capitals and distinct characters, how much of it dictionary words
cover, whether it is part of a path, what the neighbouring words say, and known prefixes. The forest is
grown from ``FINDINGS`` labelled findings, written by ``labelled_findings`` from a fixed seed; scoring is
one SQL expression. A document is scanned, and cleaned, inside its own row: nothing is shuffled and all
is SQL functions.

Defined results: a null text has no finding; each place of a value is judged by its own neighbours, and a
value found at one place is removed at all of them; repeated rows are scanned one by one; values are
returned as digests, never in clear.
"""

from __future__ import annotations

import random
import string

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinloom.llm import forest

FINDINGS = 1600
THRESHOLD = 0.5
MARK = "[SECRET]"
#: Code points of context that are looked at on either side.
AROUND = 40

# Words that name secrets, words that name other long tokens, issuers' prefixes, and a dictionary.
SECRET_WORDS = "password passwd passphrase pwd secret token apikey api_key api-key access_key access-key secret_key private_key client_secret auth authorization bearer credential credentials".split()
OTHER_WORDS = "commit sha sha1 sha256 sha512 md5 checksum digest hash etag uuid guid id isbn issn doi version build revision serial order invoice tracking phone tel fax card iban image png jpg base64 example sample placeholder".split()
PREFIXES = ("AKIA", "ASIA", "ghp_", "gho_", "ghs_", "xoxb-", "xoxp-", "sk-", "sk_live_", "rk_live_", "AIza", "eyJ", "glpat-", "npm_", "SG.")
DICTIONARY = (
    "the and for you your with that this from have not are was but all can her his one our out day get has him how man new now old see two way who boy did its let put say she too use "
    "user name pass word password secret token key change changeme example sample test demo default admin root login guest value here none null true false enter insert replace required "
    "item page file path home data info list table image photo video music book news blog post index main config setting version release build update install download upload server client "
    "local host site link text line code number order account profile service system project package module library python java script style class function method object string array "
    "time date year month week hour minute second first last next best free full long short high low open close start stop make take give find help work play read write left right"
).split()

_WORDS = "|".join(sorted(map(str.lower, SECRET_WORDS), key=len, reverse=True))
BARE = r"(?<![A-Za-z0-9+/_=-])(?=[A-Za-z+/_-]*+[0-9])[A-Za-z0-9+/_-]{12,}={0,2}"
ASSIGNED = rf"(?i)(?<![a-z0-9])(?:{_WORDS})[\"']?[ \t]{{0,3}}(?:=|:|=>)[ \t]{{0,3}}[\"']?([^\s\"',;<>]{{6,}}+)"
BLOCK = r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----(?:[\s\S]*?-----END [A-Z ]{0,40}PRIVATE KEY-----|[A-Za-z0-9+/=\r\n]*+)"
_ANY = rf"(?i)[0-9]|(?:{_WORDS})[\"']?[ \t]{{0,3}}[:=]|-----BEGIN"

_QUOTED = lambda s: "r'" + s.replace("'", r"\x27") + "'"
_SHARE = lambda pattern: f"length(regexp_replace(~v, {_QUOTED(pattern)}, '')) / ~n"

# Name -> SQL. ~v is the value, ~n its length, ~l and ~r the text on its left and right.
FEATURES: dict[str, str] = {
    "size": "least(~n, 256)",
    "turns": f"regexp_count(~v, {_QUOTED('(?<=[a-z])(?=[A-Z0-9])|(?<=[A-Z])(?=[a-z0-9])|(?<=[0-9])(?=[A-Za-z])')}) / ~n",
    "digits": _SHARE("[^0-9]"),
    "capitals": _SHARE("[^A-Z]"),
    "others": _SHARE("[A-Za-z0-9]"),
    "distinct": "size(array_distinct(split(~v, ''))) / least(~n, 40)",
    "hex": f"cast(~v rlike {_QUOTED('^[0-9a-fA-F]+$')} AS int)",
    "number": f"cast(~v rlike {_QUOTED('^[0-9+-]+$')} AS int)",
    "uuid": f"cast(~v rlike {_QUOTED('(?i)^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$')} AS int)",
    "covered": f"1 - length(regexp_replace(lower(~v), '{'|'.join(sorted(DICTIONARY, key=len, reverse=True))}', '')) / ~n",
    "path": f"cast(~v rlike {_QUOTED('^/|/.*/|[.][a-z]{2,4}$')} OR ~l rlike {_QUOTED('(://|www[.])[^ ]*$|[/.]$')} OR ~r rlike {_QUOTED('^([.][a-z]|/|@)')} AS int)",
    "secret_word": f"cast(lower(~l) rlike {_QUOTED(f'(^|[^a-z0-9])({_WORDS})[^a-z0-9]{{0,12}}$')} AS int)",
    "secret_near": f"cast(lower(concat(~l, ' ', ~r)) rlike {_QUOTED(f'(^|[^a-z0-9])({_WORDS})([^a-z0-9]|$)')} AS int)",
    "other_word": f"cast(lower(~l) rlike {_QUOTED('(^|[^a-z0-9])(' + '|'.join(OTHER_WORDS) + ')[^a-z0-9]{0,6}$')} AS int)",
    "assigned": f"cast(~l rlike {_QUOTED('[=:][ ]{0,3}[^a-zA-Z0-9 ]?$')} AS int)",
    "prefix": f"cast(~v rlike {_QUOTED('^(' + '|'.join(x.replace('.', '[.]') for x in PREFIXES) + ')[A-Za-z0-9_.-]{12,}')} AS int)",
    "block": "cast(startswith(~v, '-----BEGIN') AS int)",
}


def _over(sql: str, row: str) -> str:
    """A feature's SQL over the fields of ``row``."""
    for name in "vlrn":
        sql = sql.replace(f"~{name}", f"{row}{name}")
    return sql


def labelled_findings(n: int = FINDINGS, seed: int = 5) -> list[tuple[str, str, str, int]]:
    """(value, left, right, 1 if a secret): kinds in equal shares, from a fixed seed."""
    r = random.Random(seed)
    pick = lambda chars, k: "".join(r.choices(chars, k=k))
    hexes, upper, alnum, b64 = "0123456789abcdef", string.ascii_uppercase + string.digits, string.ascii_letters + string.digits, string.ascii_letters + string.digits + "+/"
    word = lambda: r.choice(DICTIONARY) if r.random() < 0.5 else pick("abcdefghijklmnopqrstuvwxyzéüñ", r.randint(2, 11))
    words = lambda k: " ".join(word() for _ in range(k))
    prose = lambda: words(r.randint(0, 6)) + r.choice([" ", " ", ". ", ", ", "\n"])
    sets = lambda name: name + r.choice(["=", " = ", ": ", ":", '="', ' = "', "='", '": "'])
    named = lambda: prose() + sets(r.choice(SECRET_WORDS))
    other = lambda: prose() + r.choice(OTHER_WORDS) + r.choice([" ", ": ", "=", " = ", ":"])
    decimal = lambda: str(r.randint(10**11, 10**16 - 1))
    uuid = lambda: "-".join(pick(hexes, k) for k in (8, 4, 4, 4, 12))
    true = [
        lambda: ("AKIA" + pick(upper, 16), prose()),
        lambda: (r.choice(["ghp_", "gho_", "npm_"]) + pick(alnum, 36), prose()),
        lambda: (r.choice(["sk-", "sk_live_", "xoxb-", "glpat-", "AIza"]) + pick(alnum, r.randint(20, 44)), prose()),
        lambda: ("eyJ" + pick(alnum + "_-", r.randint(60, 160)), prose()),
        lambda: (pick(hexes, r.choice([16, 18, 20, 24, 32, 40, 64])), named()),
        lambda: (pick(b64, r.choice([20, 32, 40, 44])), named()),
        lambda: (pick(alnum + "!#$%&*?@_-", r.randint(8, 20)), named()),
        lambda: (pick(alnum, r.randint(12, 40)), named()),
        lambda: (pick(b64, 40), prose()),
        lambda: ("-----BEGIN RSA PRIVATE KEY-----\n" + pick(b64, 200) + "\n-----END RSA PRIVATE KEY-----", prose()),
    ]
    false = [
        lambda: (pick(hexes, r.choice([32, 40, 64])), other()),
        lambda: (pick(hexes, r.choice([12, 16, 32, 40])), prose()),
        lambda: (uuid(), r.choice([prose, other])()),
        lambda: (decimal(), r.choice([prose, other])()),
        lambda: ("-".join([word(), word(), word(), str(r.randint(1, 99))]), prose() + r.choice(["/", "https://www.x.com/", ""])),
        lambda: ("/".join(["", word(), word(), word() + str(r.randint(1, 9))]), prose()),
        lambda: (word().capitalize() + word().capitalize() + word().capitalize() + str(r.randint(1, 999)), prose()),
        lambda: (word() + word() + pick("0123456789", r.randint(1, 4)) + word(), prose()),
        lambda: (r.choice(["changeme", "your_password_here", "xxxxxxxx", "********", "required", "password", "example_token", "replace-me-1", "<password>", "${PASSWORD}", "test1234", "insert_key_here", "secret123"]), named()),
        lambda: (word() + r.choice(["", "_"]) + word(), named()),
        lambda: (pick(b64, r.randint(40, 200)), prose() + "data:image/png;base64,"),
        lambda: (f"20{r.randint(10, 30)}{r.randint(1, 12):02}{r.randint(1, 28):02}T{r.randint(0, 235959):06}Z", prose()),
        lambda: (pick(string.ascii_uppercase, 3) + "-" + decimal(), r.choice([prose, other])()),
    ]
    out = []
    for i in range(n):
        label = i % 2
        value, left = r.choice((false, true)[label])()
        out.append((value, left[-AROUND:], (r.choice(['"', "", "'"]) if left[-1:] in "\"'" else "") + " " + words(3), label))
    return out


def train(spark, n: int = FINDINGS) -> list:
    """The forest; its features are computed by the same SQL that the scan uses."""
    rows = spark.createDataFrame(labelled_findings(n), "v string, l string, r string, label int").withColumn("n", F.length("v").cast("double"))
    found = rows.selectExpr(*[f"cast({_over(sql, '')} AS double) AS {name}" for name, sql in FEATURES.items()], "label").collect()
    table = np.array([tuple(x) for x in found])
    return forest.grow(table[:, :-1], table[:, -1])


def _sums(array: str) -> str:
    """SQL of an array's running sums."""
    return f"aggregate({array}, named_struct('at', 0, 'all', cast(array() AS array<int>)), (a, b) -> named_struct('at', a.at + b, 'all', concat(a.all, array(a.at + b))), a -> a.all)"


def _placed(t: str, pattern: str, group: int = 0) -> str:
    """SQL of an array of (start, v): a group at each match of the pattern; the group ends where its match does."""
    p = _QUOTED(pattern)
    values = f"regexp_extract_all({t}, {p}, {group})" if group else "m"
    steps = f"zip_with(m, slice(split({t}, {p}), 1, size(m)), (a, b) -> length(a) + length(b))"
    each = f"zip_with({values}, {_sums(steps)}, (a, b) -> named_struct('start', b - length(a), 'v', a))"
    return f"transform(array(regexp_extract_all({t}, {p}, 0)), m -> CASE WHEN size(m) > 0 THEN {each} ELSE array() END)[0]"


def candidates(docs: DataFrame, text: str = "text", out: str = "candidates") -> DataFrame:
    """``docs`` with an array of (v, n, l, r, start): values with the text around them, at each of their places."""
    t = f"coalesce(`{text}`, '')"
    found = f"array_sort(concat({_placed(t, BARE)}, {_placed(t, ASSIGNED, 1)}, {_placed(t, BLOCK)}))"
    placed = f"transform(array({found}), s -> filter(s, (x, i) -> i = 0 OR x <> get(s, i - 1)))[0]"
    around = f"""named_struct('v', c.v, 'n', cast(length(c.v) AS double), 'l', substring({t}, greatest(c.start - {AROUND}, 0) + 1, least(c.start, {AROUND})),
        'r', substring({t}, c.start + 1 + length(c.v), {AROUND}), 'start', c.start)"""
    full = f"CASE WHEN {t} rlike {_QUOTED(_ANY)} THEN transform({placed}, c -> {around}) ELSE array() END"
    return docs.withColumn(out, F.expr(full))


def scan(docs: DataFrame, trees: list, text: str = "text", out: str = "findings", threshold: float = THRESHOLD, every: bool = False) -> DataFrame:
    """``docs`` with ``out``: an array of (start, value, kind, score) in the text's order, start counting code points from 0.

    A value is there once, at the first place where it is a secret, or with ``every`` at each such place.
    """
    had = "__candidates"
    rest = [F.col(f"`{c}`") for c in docs.columns if c != out]
    row = ", ".join(f"'{name}', cast({_over(sql, 'c.')} AS double)" for name, sql in FEATURES.items())
    measured = f"transform({had}, c -> named_struct({row}, 'v', c.v, 'start', c.start))"
    kind = "CASE WHEN x.block > 0 THEN 'key block' WHEN x.prefix > 0 THEN 'issued key' WHEN x.secret_word > 0 THEN 'assigned' ELSE 'token' END"
    score = forest.as_sql(trees, [f"x.{name}" for name in FEATURES])
    scored = f"transform({measured}, x -> named_struct('start', cast(x.start AS bigint), 'value', x.v, 'kind', {kind}, 'score', {score}))"
    kept = f"array_sort(filter({scored}, x -> x.score >= {threshold}D))"
    if not every:
        values = "transform(k, y -> y.value)"
        kept = f"transform(array({kept}), k -> transform(array({values}), w -> filter(k, (x, i) -> array_position(w, x.value) = i + 1))[0])[0]"
    return candidates(docs.select(*rest), text, had).withColumn(out, F.expr(kept)).drop(had)


def clean(scanned: DataFrame, text: str = "text", findings: str = "findings", mark: str = MARK) -> DataFrame:
    """``scanned`` with every occurrence of each found value replaced by ``mark``; values that overlap get one mark."""
    t = f"`{text}`"
    exact = r"concat('\\Q', replace(v, '\\E', '\\E\\\\E\\Q'), '\\E')"
    steps = "transform(slice(p, 1, size(p) - 1), x -> length(x) + length(v))"
    spans = f"transform(array(split({t}, {exact})), p -> transform({_sums(steps)}, e -> named_struct('start', e - length(v), 'end', e)))[0]"
    placed = f"array_sort(flatten(transform(array_distinct(transform({findings}, x -> x.value)), v -> {spans})))"
    joined = f"""aggregate({placed}, named_struct('out', '', 'at', 0), (a, x) -> named_struct(
        'out', CASE WHEN x.start >= a.at THEN concat(a.out, substring({t}, a.at + 1, x.start - a.at), '{mark}') ELSE a.out END, 'at', greatest(a.at, x.end)),
        a -> concat(a.out, substring({t}, a.at + 1)))"""
    return scanned.withColumn(text, F.expr(f"CASE WHEN size({findings}) > 0 THEN {joined} ELSE {t} END"))


def op7(spark, sf_dir: str) -> DataFrame:
    """One row for each place of each finding; the value itself stays where it was."""
    from kinloom.llm.tables import table

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = scan(docs, train(spark), every=True).select("doc_id", F.inline("findings"))
    return found.select("doc_id", "start", F.length("value").cast("long").alias("length"), "kind", F.sha2("value", 256).alias("value_sha256"), F.round("score", 6).alias("score"))
