r"""Document fingerprints by consistent weighted sampling.

A text's terms are its lower-cased words (``[^\x20\x09-\x0D]+``), weighted by how often they occur.
For each of ``SAMPLES`` samples a term k draws, from hashes of k alone, r and c from a gamma
distribution of shape 2 and b from [0, 1). A weight w is quantised to t = floor(ln w / r + b) and scored
a = c / (y e^r) with y = e^(r (t - b)); the term of least a is the sample. As r, c and b belong to the
term, a is the same in two texts exactly if both term and t are, so a's least value stands for the
pair (k, t), and two texts agree in a sample with the probability of their generalised Jaccard
similarity, sum of least over sum of largest weights.

All is SQL functions. Documents are dealt once, by ranges of doc_id; counting a document's terms and
taking the least values need no other exchange. Ranges come from at most ``CELLS`` approximate
quantiles of doc_id, each cut evenly into parts, ``MOST_BUCKETS`` in all at most, which bounds the
broadcast of the ranges' first ids.

Defined results: a null text counts as empty; a text without words has the fingerprint ``""``, and two
of those have the likeness 1, one of them and any other 0. Repeated rows are documents of their own,
ordered by doc_id (null first) and text; a lone document is its own next one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinloom.llm.store import keep

SAMPLES = 32
SPACE = r"[ \t-\r]+"
CELLS = 256
MOST_BUCKETS = 1 << 20
#: Code points of a range of documents, about.
RANGE_CHARS = 1 << 20


def _uniform(h: str, shift: int) -> str:
    """25 bits of a hash as a number in (0, 1)."""
    return f"((shiftrightunsigned({h}, {shift}) & 33554431) + 0.5D) / 33554432D"


def sample_sql(i: int, term: str, weight: str) -> str:
    """ln a of sample i for a term's hash and the logarithm of its weight; null where that is null."""
    g, h = f"xxhash64({term}, {2 * i})", f"xxhash64({term}, {2 * i + 1})"
    r = f"(-ln({_uniform(g, 0)} * {_uniform(g, 25)}))"
    c = f"(-ln({_uniform(h, 0)} * {_uniform(h, 25)}))"
    b = f"((shiftrightunsigned({g}, 50) * 16384 + shiftrightunsigned({h}, 50)) / 268435456D)"
    return f"ln({c}) - {r} * (floor({weight} / {r} + {b}) - {b}) - {r}"


def with_bucket(docs: DataFrame, range_chars: int = RANGE_CHARS) -> DataFrame:
    """Add ``bucket``, which rises with doc_id and holds about ``range_chars`` code points."""
    ids = F.col("doc_id").cast("double")
    found = docs.agg(F.sum(F.length("text")).alias("n"), F.count("doc_id").alias("rows"), F.percentile_approx(ids, [i / CELLS for i in range(1, CELLS)], 4 * CELLS).alias("cuts"), F.min(ids).alias("low"), F.max(ids).alias("high")).first()
    if not found.rows:
        return docs.withColumn("bucket", F.lit(0).cast("long"))
    edges = sorted({found.low, *found.cuts, found.high})
    wanted = min(MOST_BUCKETS, max(1, -(-(found.n or 0) // range_chars)))
    step = max(1, len(edges) * 1.0 / wanted)
    edges = sorted({edges[min(len(edges) - 1, int(i * step))] for i in range(int(len(edges) / step) + 1)} - {found.high} | {found.low})
    parts = max(1, wanted // len(edges))
    low = F.lit(edges)
    cell = F.greatest(F.size(F.filter(low, lambda x: x <= ids)), F.lit(1)) - 1
    upper = F.lit([*edges[1:], found.high + 1])
    part = F.least(F.floor((ids - low[cell]) * parts / (upper[cell] - low[cell])), F.lit(parts - 1))
    return docs.withColumn("bucket", F.when(ids.isNull(), -1).otherwise(cell * parts + part).cast("long"))


def with_next(docs: DataFrame, range_chars: int = RANGE_CHARS) -> DataFrame:
    """``bucket, rid, doc_id, text, next_text, next_bucket, next_rid``: each document beside the next one.

    The first document of each range is also dealt to the range before it, behind its last document.
    """
    rows = with_bucket(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")), range_chars)
    # One row a range, so this window over all ranges is small.
    ring = Window.orderBy("bucket")
    firsts = rows.groupBy("bucket").agg(F.min("doc_id").alias("first_id"))
    firsts = firsts.select("bucket", "first_id", F.coalesce(F.lag("bucket").over(ring), F.max("bucket").over(Window.partitionBy())).alias("before"))
    marked = rows.join(F.broadcast(firsts), "bucket")
    is_first = F.col("doc_id").eqNullSafe(F.col("first_id"))
    own = F.struct(F.col("bucket").alias("seat"), F.lit(False).alias("guest"))
    guest = F.struct(F.col("before").alias("seat"), F.lit(True).alias("guest"))
    dealt = marked.select("bucket", "doc_id", "text", F.inline(F.when(is_first, F.array(own, guest)).otherwise(F.array(own))))
    line = Window.partitionBy("seat").orderBy("guest", "doc_id", "text")
    then = lambda c: F.lead(c).over(line)
    placed = dealt.select("seat", "guest", F.row_number().over(line).alias("rid"), "doc_id", "text", then("text").alias("next_text"), then("bucket").alias("next_bucket"), then("guest").alias("next_guest"))
    # The last two conditions always hold; with them each plan over this deals the same columns and rows, so the exchange of texts is reused.
    return placed.filter("NOT guest AND bucket >= -1 AND seat IS NOT NULL").select(F.col("seat").alias("bucket"), "rid", "doc_id", "text", "next_text", "next_bucket", F.when(F.col("next_guest"), 1).otherwise(F.col("rid") + 1).alias("next_rid"))


def _words(text: Column) -> Column:
    return F.split(F.lower(text), SPACE)


def signatures(texts: DataFrame, keys: list[str], columns: list[str], samples: int = SAMPLES) -> DataFrame:
    """``keys`` and, for each text column, an array of ``samples`` 32-bit hashes; rows without words are left out."""
    tagged = lambda k: lambda w: F.struct(w.alias("w"), F.lit(k).alias("k"))
    each = [F.transform(_words(F.col(c)), tagged(k)) for k, c in enumerate(columns)]
    words = texts.select(*keys, F.inline(F.concat(*each))).filter("w <> ''")
    terms = words.groupBy(*keys, F.xxhash64("w").alias("term")).agg(*[F.sum(F.when(F.col("k") == k, 1)).alias(f"n{k}") for k in range(len(columns))])
    terms = terms.select(*keys, "term", *[F.log(F.col(f"n{k}").cast("double")).alias(f"w{k}") for k in range(len(columns))])
    least = terms.groupBy(*keys).agg(*[F.min(F.expr(sample_sql(i, "term", f"w{k}"))).alias(f"a{k}_{i}") for i in range(samples) for k in range(len(columns))])
    hashed = lambda k: F.when(F.col(f"a{k}_0").isNotNull(), F.array(*[F.hash(f"a{k}_{i}") for i in range(samples)]))
    return least.select(*keys, *[hashed(k).alias(f"sig{k}") for k in range(len(columns))])


def likeness(a: str, b: str, samples: int = SAMPLES) -> Column:
    same = F.expr(f"aggregate(zip_with({a}, {b}, (x, y) -> if(x = y, 1, 0)), 0, (n, x) -> n + x) / {samples}D")
    return F.when(F.col(a).isNull() & F.col(b).isNull(), 1.0).when(F.col(a).isNull() | F.col(b).isNull(), 0.0).otherwise(same)


def text_of(sig: str) -> Column:
    return F.coalesce(F.expr(f"array_join(transform({sig}, x -> lpad(lower(hex(x)), 8, '0')), '')"), F.lit(""))


def fingerprints(docs: DataFrame, samples: int = SAMPLES, range_chars: int = RANGE_CHARS) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next."""
    n = F.length("text")
    cut = F.floor(n / 4).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), n - cut), F.substring(F.col("next_text"), F.lit(1), cut))
    texts = with_next(docs, range_chars).withColumn("edited", edited)
    meta = texts.select("bucket", "rid", "doc_id", "next_bucket", "next_rid", n.cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"))
    own = keep(meta.join(signatures(texts, ["bucket", "rid"], ["text", "edited"], samples), ["bucket", "rid"], "left"), "fingerprints")
    after = own.select(F.col("bucket").alias("next_bucket"), F.col("rid").alias("next_rid"), F.col("sig0").alias("next_sig"))
    both = own.join(after, ["next_bucket", "next_rid"])
    return both.select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        text_of("sig0").alias("fingerprint"),
        text_of("sig1").alias("edited_fingerprint"),
        likeness("sig0", "sig1", samples).alias("near_edited"),
        likeness("sig0", "next_sig", samples).alias("near_next"),
    )


def op9(spark, sf_dir: str) -> DataFrame:
    from kinloom.llm.tables import table

    return fingerprints(table(spark, sf_dir, "documents"))
