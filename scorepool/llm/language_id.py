"""Language ID by error-correcting output codes over hashed byte n-grams.

Each language has a codeword; each bit of it is a binary classifier (log-odds of hashed n-gram counts, trained on a bounded
sample of labelled rows, which are counted where they are read). Loss-weighted decoding sums the logistic loss of every bit's margin against each codeword and takes
the least; a small lead over the runner-up marks the text as ambiguous.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scorepool.llm.common import _LOWER, doc_text, slices, utf8

#: Labelled rows used for training, about as many of each language; the bound of the sample. Every language is learned.
SAMPLE_PER_LANGUAGE = 400
BUCKETS = 1 << 16
#: Weight of a margin's unit in the logistic loss: n-grams of a text overlap, so their log-odds count for less than one each.
DAMPING = 0.25
#: Scores under this are flagged as ambiguous.
AMBIGUOUS = 0.6
UNDETERMINED = "und"


def codewords(n: int) -> np.ndarray:
    """Rows of +1 and -1, one for each class: all distinct splits for up to 5 classes, else fixed random ones of 12 log2(n) bits."""
    if n <= 1:
        return np.ones((n, 1))
    if n <= 5:
        columns = [[1 if k == 0 or not (mask >> (k - 1)) & 1 else -1 for k in range(n)] for mask in range(1, 1 << (n - 1))]
        return np.array(columns, float).T
    rng, bits = np.random.default_rng(11), int(12 * np.ceil(np.log2(n)))
    best = None
    for _ in range(50 if n <= 1000 else 1):
        code = np.where(rng.random((n, bits)) < 0.5, 1.0, -1.0)
        near = (code @ code.T - 2 * bits * np.eye(n)).max() if n <= 1000 else 0
        if best is None or near < best[0]:
            best = (near, code)
    return best[1]


def grams(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashed byte trigrams of lower-cased texts, each text padded by a space in front; one for each byte, and text bounds."""
    x = _LOWER[data].astype(np.uint32)
    accented = np.zeros(len(x), bool)
    accented[1:] = (x[:-1] == 0xC3) & (x[1:] >= 0x80) & (x[1:] <= 0x9E) & (x[1:] != 0x97)
    x[accented] += 0x20
    x[((x >= 48) & (x <= 57))] = 48
    one, two = np.full(len(x), 32, np.uint32), np.full(len(x), 32, np.uint32)
    one[1:], two[2:] = x[:-1], x[:-2]
    first = offsets[:-1][offsets[:-1] < offsets[1:]]
    one[first], two[first] = 32, 32
    two[np.minimum(first + 1, max(len(x) - 1, 0))] = 32
    return ((x | (one << 8) | (two << 16)) * np.uint32(0x9E3779B1)) >> np.uint32(16), offsets


@dataclass
class Model:
    languages: list[str]
    code: np.ndarray
    weights: np.ndarray  # buckets x bits

    def losses(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Loss of each language for each text."""
        h, bounds = grams(data, offsets)
        margin = np.zeros((len(bounds) - 1, self.weights.shape[1]))
        full = np.flatnonzero(bounds[1:] > bounds[:-1])
        if len(full):
            for bit in range(self.weights.shape[1]):
                margin[full, bit] = np.add.reduceat(self.weights[:, bit][h], bounds[full], dtype=np.float64)
        z = DAMPING * margin
        return np.logaddexp(0, -z) @ (self.code > 0).T + np.logaddexp(0, z) @ (self.code < 0).T

    def predict(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        loss = self.losses(data, offsets)
        best = loss.argmin(1)
        share = np.exp(-(loss - loss.min(1, keepdims=True)))
        return best, 1 / share.sum(1)


def counted(texts: pa.Array) -> np.ndarray:
    """How many n-grams of the texts fall into each bucket."""
    return np.bincount(grams(*utf8(texts))[0], minlength=BUCKETS)


def fit(languages: list[str], counts: Iterable[tuple[str, np.ndarray]]) -> Model | None:
    """Log-odds of each bucket for each bit, from each language's counts in turn; every language weighs the same.
    None without languages."""
    if not languages:
        return None
    code = codewords(len(languages))
    on, total = np.zeros((BUCKETS, code.shape[1])), np.zeros((BUCKETS, 1))
    held = dict.fromkeys(languages)
    for language, n in counts:
        rate = ((n + 0.05) / (n.sum() + 0.05 * BUCKETS))[:, None]
        on += rate * (code[languages.index(language)] > 0)
        total += rate
        del held[language]
    for language in held:  # the sample has no row of it
        on += (code[languages.index(language)] > 0) / BUCKETS
        total += 1 / BUCKETS
    many = (code > 0).sum(0)
    both = many < len(languages)
    weights = np.where(both, np.log(on / many) - np.log(np.maximum(total - on, 1e-300) / np.maximum(len(languages) - many, 1)), 0.0)
    return Model(languages, code, weights.astype(np.float32))


def train(docs: DataFrame, sample_per_language: int = SAMPLE_PER_LANGUAGE) -> Model | None:
    """Learns every language of docs (doc_id, text, lang) from about sample_per_language of its rows, those of the least hashes.

    Rows without text or language teach nothing. Tasks add up their rows' buckets and the driver gets one row of BUCKETS counts
    for each language, one at a time; no text leaves the executors.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang")).where("lang is not null and text is not null")
    sizes = {r["lang"]: r["count"] for r in docs.groupBy("lang").count().collect()}
    if not sizes:
        return None
    languages = sorted(sizes)
    # a share of each language by a hash of the row: no ranking, so no language is one task's work
    share = F.map_from_arrays(F.lit(languages), F.lit([min(1 << 31, sample_per_language * (1 << 31) // sizes[x] + 1) for x in languages]))
    rows = docs.where(F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 31)) < F.try_element_at(share, F.col("lang"))).select("lang", "text")

    def count(batches):
        held: dict[str, np.ndarray] = {}
        for batch in batches:
            names = np.array(batch.column("lang").to_pylist(), object)
            for name in sorted(set(names)):
                for part in slices(batch.filter(pa.array(names == name))):
                    held[name] = held.get(name, 0) + counted(part.column("text"))
        for name, n in held.items():
            at = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([at.astype("<u2").tobytes()]), pa.array([n[at].astype("<i8").tobytes()])], names=["lang", "bucket", "n"])

    def add(table):
        total = np.zeros(BUCKETS, np.int64)
        for at, n in zip(table.column("bucket"), table.column("n"), strict=True):
            total[np.frombuffer(at.as_buffer(), "<u2")] += np.frombuffer(n.as_buffer(), "<i8")
        return pa.table({"lang": table.column("lang")[:1], "n": [total.astype("<i8").tobytes()]})

    sums = rows.mapInArrow(count, "lang string, bucket binary, n binary").groupBy("lang").applyInArrow(add, "lang string, n binary")
    # in order of language, so that sums of doubles come out alike each time
    return fit(languages, ((r["lang"], np.frombuffer(r["n"], "<i8")) for r in sums.orderBy("lang").toLocalIterator()))


def _lettered(text: str) -> bool:
    return any(unicodedata.category(c)[0] == "L" for c in text)


def _judged(batches, own: Model | None):
    """Slices of rows with the predicted language and the score of each."""
    for batch in batches:
        for part in slices(batch):
            data, offsets = utf8(part.column("text"))
            ascii_letter = ((data | 32) >= 97) & ((data | 32) <= 122)
            seen = np.concatenate([[0], np.cumsum(ascii_letter)])
            lettered = seen[offsets[1:]] > seen[offsets[:-1]]
            for i in np.flatnonzero(~lettered):
                lettered[i] = _lettered(data[offsets[i] : offsets[i + 1]].tobytes().decode("utf-8", "replace"))
            if own is None:
                lettered[:] = False
                best, score = np.zeros(part.num_rows, int), np.zeros(part.num_rows)
                names = [UNDETERMINED]
            else:
                (best, score), names = own.predict(data, offsets), own.languages
            yield part, [names[k] if ok else UNDETERMINED for k, ok in zip(best, lettered, strict=True)], np.where(lettered, score, 0.0)


def identify(docs: DataFrame, model: Model | None) -> DataFrame:
    """Per row of docs: doc_id, lang_pred, score (0 to 1), ambiguous.

    `und` with score 0 for a null text, a text without a letter (Unicode category L), or without a model. Very long texts are
    judged whole, in a pass of their own. Ties go to the language first in
    alphabetical order. Null ids, repeated rows, empty tables and clashing extra columns are allowed; row count is kept.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)  # at most BUCKETS x bits of the codebook

    def run(batches):
        for part, names, score in _judged(batches, held.value):
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(names, pa.string()), pa.array(score), pa.array(score < AMBIGUOUS)], names=["doc_id", "lang_pred", "score", "ambiguous"])

    return doc_text(docs).mapInArrow(run, "doc_id long, lang_pred string, score double, ambiguous boolean")


def identified(docs: DataFrame, model: Model | None) -> DataFrame:
    """The rows of docs whose language can be told without ambiguity, all columns kept. Each row is judged where it is read.

    Null, empty and letterless texts go, and all rows where there is no model; very long texts are judged whole; repeated rows
    are judged alike; an empty table gives none; other columns, whatever their names, pass through.
    """
    docs = docs.withColumn("text", F.col("text").cast("string"))
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for part, _, score in _judged(batches, held.value):
            yield part.filter(pa.array(score >= AMBIGUOUS))

    return docs.mapInArrow(run, docs.schema)
