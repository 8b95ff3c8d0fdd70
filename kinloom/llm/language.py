"""Language identification with a string kernel.

A text's blended spectrum is the set of its character 1-, 2- and 3-grams, lower-cased, with all but
letters and marks turned into single spaces. The presence kernel of two texts is the number of n-grams
they share over the root of the product of their numbers. Landmark texts give Nystroem features, on
which one-versus-rest kernel ridge regression learns each language. As all of that is linear in the
landmark's n-grams, the landmarks' part is multiplied out once: a batch of texts is scored by one
product of its presence matrix with an n-gram by language matrix.

Bounds of the labelled sample: of the ``LANGUAGES`` most frequent lang values, each has at most
``PER_LANGUAGE`` training rows, in the order of a hash of doc_id, and no more than make up its share of
``NGRAMS`` n-grams, or else one row. ``LANDMARKS`` of the rows are landmarks, taken evenly from the
languages. The broadcast matrix has a row for each n-gram of the landmarks; none is left out. Matrices are
multiplied ``COLUMNS`` n-grams at a time.

A row without doc_id is not held out.

Defined results: a text that is null or has no letter is ``und`` with score 0; so is every text if no
labelled row with a letter exists. Repeated rows are judged one by one, ties go to the language that
sorts first, lang, source and doc_id take no part in a prediction.
"""

from __future__ import annotations

import functools
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinloom.llm.store import small_batches

UNDETERMINED = "und"
PER_LANGUAGE = 400
LANDMARKS = 256
RIDGE = 1e-3
LANGUAGES = 1024
NGRAMS = 1 << 23
COLUMNS = 1 << 16
#: Code points whose n-grams are gathered at once; a longer text's stretches hand over their last characters.
STRETCH = 1 << 20
#: Texts scored by one matrix product.
ROWS = 64


@functools.cache
def _letters() -> np.ndarray:
    """For each code point: 2 a letter, 1 a mark, 0 anything else."""
    table = np.zeros(0x110000, dtype=np.uint8)
    kinds = {"L": 2, "M": 1}
    for x in range(0x110000):
        if k := kinds.get(unicodedata.category(chr(x))[0]):
            table[x] = k
    return table


def spectrum(text: str | None) -> np.ndarray:
    """The distinct n-grams as sorted 64-bit codes, 21 bits a character; empty if there is no letter."""
    found, last, letters = None, [32], False
    text = (text or "").lower()
    for at in range(0, len(text), STRETCH):
        a = np.frombuffer(text[at : at + STRETCH].encode("utf-32-le", "surrogatepass"), dtype="<u4")
        kind = _letters()[a]
        letters = letters or bool((kind == 2).any())
        end = [32] if at + STRETCH >= len(text) else []
        c = np.empty(len(last) + len(a) + len(end), dtype=np.int64)
        c[: len(last)], c[len(last) : len(last) + len(a)], c[len(last) + len(a) :] = last, np.where(kind, a, 32), end
        c = c[np.append(True, (c[1:] != 32) | (c[:-1] != 32))]
        two = (c[:-1] << 21) | c[1:]
        three = (two[:-1] << 21) | c[2:]
        found = np.unique(np.concatenate([c, two, three] if found is None else [found, c, two, three]))
        last = c[-2:]
    return found if letters else np.empty(0, dtype=np.int64)


def held_out(doc_id: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 3 == 1, F.lit(False))


def _places(ngrams: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """Places in ``ngrams`` (sorted) of those ``codes`` that it has."""
    at = np.searchsorted(ngrams, codes)
    at[at == len(ngrams)] = 0
    return at[ngrams[at] == codes] if len(ngrams) else at[:0]


def _presence(places: list[np.ndarray], width: int) -> np.ndarray:
    out = np.zeros((len(places), width), dtype=np.float32)
    for row, at in zip(out, places, strict=True):
        row[at] = 1
    return out


class Model:
    def __init__(self, languages: list[str], ngrams: np.ndarray, weights: np.ndarray, offset: np.ndarray) -> None:
        self.languages, self.ngrams, self.weights, self.offset = languages, ngrams, weights, offset

    def decide(self, spectra: list[np.ndarray]) -> np.ndarray:
        """Values of the one-versus-rest machines, a row for each spectrum."""
        where = [_places(self.ngrams, x) for x in spectra]
        values = np.zeros((len(spectra), len(self.languages)), dtype=np.float32)
        for low in range(0, len(self.ngrams), COLUMNS):
            own = self.weights[low : low + COLUMNS]
            cut = [x[slice(*np.searchsorted(x, (low, low + COLUMNS)))] - low for x in where] if len(self.ngrams) > COLUMNS else where
            if any(map(len, cut)):
                values += _presence(cut, len(own)) @ own
        size = np.sqrt(np.maximum([len(x) for x in spectra], 1))[:, None]
        return values / size + self.offset

    def known(self, codes: np.ndarray) -> float:
        """The share of a spectrum's 3-grams that some landmark has; 0 if there is none."""
        three = codes[codes >= 1 << 42]
        if not len(three) or not len(self.ngrams):
            return 0.0
        at = np.minimum(np.searchsorted(self.ngrams, three), len(self.ngrams) - 1)
        return float((self.ngrams[at] == three).mean())

    def predict(self, texts) -> list[tuple[str, float, float]]:
        """Language, score and ``known`` of each text."""
        spectra = [spectrum(t) for t in texts]
        if not self.languages:
            return [(UNDETERMINED, 0.0, 0.0)] * len(spectra)
        values = np.concatenate([self.decide(spectra[i : i + ROWS]) for i in range(0, len(spectra), ROWS)])
        best = values.argmax(axis=1)
        score = np.clip((values.max(axis=1) + 1) / 2, 0, 1)
        return [(self.languages[b], float(s), self.known(x)) if len(x) else (UNDETERMINED, 0.0, 0.0) for x, b, s in zip(spectra, best, score, strict=True)]


def fit(spectra: list[np.ndarray], labels: list[str], landmarks: int = LANDMARKS, ridge: float = RIDGE) -> Model:
    """Nystroem features of the normalised presence kernel, then ridge regression for each language."""
    languages = sorted(set(labels))
    if not languages:
        return Model([], np.empty(0, np.int64), np.empty((0, 0), np.float32), np.empty(0, np.float32))
    own = [[i for i, x in enumerate(labels) if x == lang] for lang in languages]
    share = max(1, landmarks // len(languages))
    marks = [i for rows in own for i in rows[:share]]
    ngrams = np.unique(np.concatenate([spectra[i] for i in marks]))
    where = [_places(ngrams, x) for x in spectra]
    scale = 1 / np.sqrt([len(x) for x in spectra])

    def block(rows, low):
        """The normalised presence of some n-grams in ``rows``."""
        width = min(COLUMNS, len(ngrams) - low)
        cut = [where[i][slice(*np.searchsorted(where[i], (low, low + width)))] - low for i in rows]
        return _presence(cut, width) * scale[list(rows), None].astype(np.float32)

    kernel = np.zeros((len(labels), len(marks)))
    for low in range(0, len(ngrams), COLUMNS):
        base = block(marks, low)
        for i in range(0, len(labels), LANDMARKS):
            kernel[i : i + LANDMARKS] += block(range(i, min(i + LANDMARKS, len(labels))), low) @ base.T
    values, vectors = np.linalg.eigh(kernel[marks])
    good = values > 1e-6 * values[-1]
    root = vectors[:, good] / np.sqrt(values[good])
    features = kernel @ root
    target = np.where(np.array(labels)[:, None] == np.array(languages)[None, :], 1.0, -1.0)
    weight = np.array([1 / len(own[languages.index(x)]) for x in labels])[:, None] / len(languages)  # each language counts the same
    mean = (weight * features).sum(axis=0)
    level = (weight * target).sum(axis=0)
    centred = features - mean
    gram = centred.T @ (weight * centred) + ridge * np.eye(len(mean))
    w = np.linalg.solve(gram, centred.T @ (weight * (target - level)))
    weights = np.concatenate([block(marks, low).T @ (root @ w) for low in range(0, len(ngrams), COLUMNS)])
    return Model(languages, ngrams, weights.astype(np.float32), (level - mean @ w).astype(np.float32))


def train(docs: DataFrame, per_language: int = PER_LANGUAGE, landmarks: int = LANDMARKS, ridge: float = RIDGE, ngrams: int = NGRAMS) -> Model:
    """Learn from ``text`` and non-null ``lang`` of the rows that aren't held out."""
    small_batches(docs.sparkSession)
    rows = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out()).select("doc_id", "lang", "text")
    counts = {r.lang: r.n for r in rows.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(LANGUAGES).collect()}
    if not counts:
        return fit([], [])
    most = ngrams // len(counts)
    # A draw by hash of a fifth and 20 more rows than wanted; the hash order decides which of them stay.
    unit = F.pmod(F.xxhash64(F.col("doc_id").cast("string"), F.lit("lang")), F.lit(1 << 30))
    limit = spark_map({lang: int((1 << 30) * min(1.0, (1.2 * per_language + 20) / n)) for lang, n in counts.items()})
    drawn = rows.withColumn("unit", unit).filter(F.col("unit") < limit[F.col("lang")])

    def spectra(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            codes = [spectrum(t) for t in batch["text"]]
            yield pd.DataFrame({"lang": batch["lang"], "unit": batch["unit"], "codes": [c.tobytes() for c in codes]})

    found: dict[str, list] = {}
    for r in drawn.mapInPandas(spectra, "lang string, unit long, codes binary").toLocalIterator():
        if r.codes:
            own = sorted([*found.get(r.lang, []), (r.unit, bytes(r.codes))])[:per_language]
            sizes = np.cumsum([len(c) // 8 for _, c in own])
            found[r.lang] = own[: max(1, int(np.searchsorted(sizes, most, "right")))]
    taken = [(lang, np.frombuffer(c, dtype=np.int64)) for lang in sorted(found) for _, c in found[lang]]
    return fit([c for _, c in taken], [lang for lang, _ in taken], landmarks, ridge)


def spark_map(values: dict[str, int]) -> Column:
    return F.create_map(*[x for k, v in values.items() for x in (F.lit(k), F.lit(v))])


def identify(docs: DataFrame, model: Model, text: str = "text", known: str | None = None) -> DataFrame:
    """``docs`` with ``lang_pred`` and ``score`` from the whole text; a pass over the rows, no shuffle.

    ``known`` names a column for the share of the text's 3-grams that the landmarks know.
    """
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("lang_pred string, score double, known double")
    def predict(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame(shared.value.predict(batch), columns=["lang_pred", "score", "known"])

    own = {"lang_pred": "lang_pred", "score": "score"} | ({known: "known"} if known else {})
    rest = [F.col(f"`{c}`") for c in docs.columns if c not in own]
    found = docs.select(*rest, predict(F.col(text)).alias("__language"))
    return found.select(*rest, *[F.col(f"__language.{field}").alias(name) for name, field in own.items()])


def op1(spark, sf_dir: str) -> DataFrame:
    from kinloom.llm.tables import table

    docs = table(spark, sf_dir, "documents")
    model = train(docs)
    found = identify(docs.select("doc_id", "text", held_out().alias("held_out")), model)
    return found.select("doc_id", "held_out", "lang_pred", "score")
