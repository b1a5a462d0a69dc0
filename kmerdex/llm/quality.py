"""Quality classifier: hashed word n-grams, logistic regression, follow-the-regularised-leader updates.

Features of a text are the one- and two-word runs of its words and of its words' shapes (letter case, what
a word ends with, whether it repeats the one before), hashed into a fixed number of places and weighted by count
over the Euclidean length of all counts. A score is the sparse dot product with the weights. Training
takes a bounded sample of labelled rows; every text is scored whole.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import shared

#: Places for hashed features.
PLACES = 1 << 18
#: Labelled rows that are learned from at most: those whose ids have the smallest hashes.
LABELLED_ROWS = 4_000
EPOCHS = 4


class Ftrl:
    """Logistic regression by FTRL-proximal updates, one row of sparse features at a time."""

    def __init__(self, places: int, alpha: float = 0.5, beta: float = 1.0, l1: float = 0.002, l2: float = 0.0):
        self.z, self.n = np.zeros(places), np.zeros(places)
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2

    def weights(self, at=slice(None)) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        w = -(z - np.sign(z) * self.l1) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2)
        return np.where(np.abs(z) <= self.l1, 0.0, w)

    def learn(self, at: np.ndarray, value: np.ndarray, label: int, weight: float = 1.0) -> None:
        w = self.weights(at)
        p = 1 / (1 + np.exp(-np.clip(w @ value, -35, 35)))
        g = (p - label) * value * weight
        n = self.n[at]
        more = n + g * g
        self.z[at] += g - (np.sqrt(more) - np.sqrt(n)) / self.alpha * w
        self.n[at] = more


def shapes(w: shared.Words, h: np.ndarray) -> np.ndarray:
    """A small code for the form of each word."""
    data = w.data
    upper, lower = (data >= 65) & (data <= 90), (data >= 97) & (data <= 122)

    def per_word(mask):
        sums = np.zeros(len(data) + 1, np.int64)
        np.cumsum(mask, out=sums[1:])
        return sums[w.ends] - sums[w.starts]

    n, ups, lows = w.ends - w.starts, per_word(upper), per_word(lower)
    case = np.where(ups == 0, 0, np.where(lows == 0, np.where(n > 1, 2, 1), 3))
    plain = upper | lower | (data >= 128) | ((data >= 48) & (data <= 57))
    mark = np.where(plain, 0, data).astype(np.int64)
    last = mark[w.ends - 1] if len(n) else np.zeros(0, np.int64)
    second = np.where(n > 1, mark[np.maximum(w.ends - 2, 0)], 0) if len(n) else last
    again = np.zeros(len(n), bool)
    if len(n):
        again[1:] = (h[1:] == h[:-1]) & (w.row[1:] == w.row[:-1])
    return (((case * 2 + again) * 256 + last) * 256 + second).astype(np.uint64)


def features(texts: pa.Array, places: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, place, value): each text's hashed features with values of unit Euclidean length."""
    w = shared.Words(texts)
    h = w.hashes()
    s = shared.mixed(shapes(w, h), 11)
    rows, keys = [], []
    for seed, x in ((1, h), (2, s)):
        rows.append(w.row)
        keys.append(shared.mixed(x, seed))
        if len(x) > 1:
            inside = w.row[1:] == w.row[:-1]
            rows.append(w.row[1:][inside])
            keys.append(shared.mixed(shared.grams(x, 2), seed + 10)[inside])
    row, key = np.concatenate(rows), np.concatenate(keys)
    both, count = np.unique(row.astype(np.int64) * places + (key % np.uint64(places)).astype(np.int64), return_counts=True)
    row, place = both // places, both % places
    size = np.bincount(row, weights=count.astype(float) ** 2, minlength=len(texts))
    return row, place, count / np.sqrt(size[row])


def sampled(labels: DataFrame, label: str, fit: Column, rows: int) -> DataFrame:
    """(doc_id, label): at most so many labelled rows for which fit holds, the same ones on every run."""
    known = labels.where(fit & F.col(label).isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max(label).alias("label"))
    return known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)


def train(docs: DataFrame, labels: DataFrame, label: str, fit: Column, rows: int = LABELLED_ROWS, places: int = PLACES, epochs: int = EPOCHS) -> np.ndarray:
    """Weights; the last one is the bias. All are zero where no row is labelled, and in an empty table.

    The sample has a bound, so its ids may be broadcast and its features gathered by the driver. Of labels repeated for an id the largest
    holds; rows repeated under an id are learned from each; null texts have no features; ids are long numbers, and null ids are not learned from.
    """
    chosen = docs.select("doc_id", "text").join(F.broadcast(sampled(labels, label, fit, rows)), "doc_id").select("text", "label", "doc_id")

    def run(batches):
        for b in batches:
            for part, texts in shared.slices([b], 0):
                row, place, value = features(texts, places)
                cut = np.searchsorted(row, np.arange(len(texts) + 1))
                at = [place[a:z].astype(np.int32).tobytes() for a, z in zip(cut[:-1], cut[1:])]
                of = [value[a:z].astype(np.float32).tobytes() for a, z in zip(cut[:-1], cut[1:])]
                yield pa.RecordBatch.from_arrays([part.column(1).cast(pa.int32()), part.column(2).cast(pa.int64()), pa.array(at, pa.binary()), pa.array(of, pa.binary())], ["label", "doc_id", "at", "value"])

    got = chosen.mapInArrow(run, "label int, doc_id long, at binary, value binary").toArrow().to_pylist()
    got.sort(key=lambda r: (r["doc_id"], r["at"]))
    model = Ftrl(places + 1)
    for _ in range(epochs):
        for i in np.random.default_rng(7).permutation(len(got)):
            r = got[i]
            at = np.append(np.frombuffer(r["at"], np.int32), places)
            model.learn(at, np.append(np.frombuffer(r["value"], np.float32), 1.0).astype(float), r["label"])
    return model.weights()


def score(docs: DataFrame, weights: np.ndarray, text: str = "text", out: str = "score") -> DataFrame:
    """docs with a double column out from 0 to 1; null and empty texts get the bias alone. A column of that name is replaced.

    Rows are kept, repeated ones too, with all other columns; texts of any length are scored whole; an empty table gives an empty one.
    """
    shared.tune(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(weights)  # of fixed size

    def make():
        w = sent.value

        def f(texts):
            row, place, value = features(texts, len(w) - 1)
            total = np.bincount(row, weights=w[place] * value, minlength=len(texts)) + w[-1]
            return [pa.array(1 / (1 + np.exp(-np.clip(total, -700, 700))))]

        return f

    return shared.extended(docs, text, make, f"{out} double")


def remainder(by: int) -> Column:
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % by


def op3_quality(spark, sf_dir: str) -> DataFrame:
    """Score of each document for quality; a null or empty text gets the bias alone."""
    shared.tune(spark)
    docs = shared.read(spark, sf_dir, "documents").select("doc_id", "text")
    weights = train(docs, shared.read(spark, sf_dir, "labels"), "quality", remainder(3) != 1)
    return score(docs, weights).select("doc_id", (remainder(3) == 1).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
