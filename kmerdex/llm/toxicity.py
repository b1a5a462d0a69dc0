"""Toxicity: noisy-channel restoration of disguised words, then a lexicon model over the restored text.

A disguised word is decoded as the best path through a lattice of characters: a sign may stand for the
letters it resembles, a run of one letter for one or two of them, a separator for nothing or for a word
boundary. The path is weighed by the channel's costs and a character trigram model that is counted over
all documents. Whole, plain words are their own only path and are not decoded again. The restored words
and their beginnings are features of a logistic model trained by FTRL.
"""

from __future__ import annotations

import re
import string

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import shared
from .quality import Ftrl, remainder, sampled

#: Letters that a sign may stand for.
LEET = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "il", "|": "il", "+": "t", "(": "c", "€": "e", "£": "l"}
SEPARATORS = " .-_*~'"
#: Channel costs, in nats.
SUBSTITUTE, SHORTEN, HALVE, DROP, KEEP, EDGE = 0.7, 0.2, 1.5, 0.3, 4.0, 1.0
#: Labelled rows that are learned from at most.
LABELLED_ROWS = 8_000
#: Least log-likelihood ratio, in favour of toxic texts, of a feature that is learned.
EVIDENCE = 15.0
EPOCHS = 8
#: Lengths of the beginnings of words that are features beside the word.
BEGINNINGS = (4, 5, 6)
SYMBOLS = 28
#: Decoded words that a task remembers.
REMEMBERED = 300_000

#: Symbol of the character model by byte: 1-26 letters, 27 anything beyond ASCII, 0 all else.
CODE = np.zeros(256, np.int64)
CODE[97:123] = CODE[65:91] = np.arange(1, 27)
CODE[128:] = 27

#: Three or more single characters in a row, each on its own: one blank between them, and any white space.
SPACED = re.compile(r"(?<!\S)(?:\S ){2,}\S(?!\S)")
WIDE = re.compile(r"(?<!\S)(?:\S\s+){2,}\S(?!\S)")
#: A sign inside or in front of letters, separators inside a word with letters, or a letter twice or more.
DISGUISED = re.compile(r"[0-9@$!|+(€£][^\W\d_]|[^\W\d_][.\-_*~']+[^\W_]|[^\W_][.\-_*~']+[^\W\d_]|([^\W\d_])\1")
EDGES = string.punctuation


def character_counts(docs: DataFrame, text: str) -> np.ndarray:
    """Trigram counts over all texts: SYMBOLS ** 3 numbers whatever the data. Summed per task before they are shuffled."""
    places = SYMBOLS**3

    def run(batches):
        total = np.zeros(places, np.int64)
        for b in batches:
            for _, texts in shared.slices([b], 0):
                w = shared.Words(texts)
                # texts follow each other; a boundary stands before and behind each
                c = np.append(np.insert(CODE[w.data], w.offsets[:-1], 0), 0)
                if len(c) > 2:
                    t = (c[:-2] * SYMBOLS + c[1:-1]) * SYMBOLS + c[2:]
                    total += np.bincount(t, minlength=places)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["place", "n"])

    got = docs.select(text).mapInArrow(run, "place long, n long").groupBy("place").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(places)
    out[got.column(0).to_numpy()] = got.column(1).to_numpy()
    return out.reshape(SYMBOLS, SYMBOLS, SYMBOLS)


class Decoder:
    """Viterbi search over the lattice of a disguised word."""

    def __init__(self, counts: np.ndarray):
        share = (counts + 0.05) / (counts.sum(axis=2, keepdims=True) + 0.05 * SYMBOLS)
        self.cost = (-np.log(share)).tolist()

    @staticmethod
    def symbol(c: str) -> int:
        return ord(c) - 96 if "a" <= c <= "z" else 27 if c.isalpha() else 0

    @staticmethod
    def options(c: str, run: int, edge: bool = False) -> list[tuple[str, float]]:
        """What a run of one character may stand for, with costs; edge: next to the first or last character, which may be a word of one letter."""
        out: list[tuple[str, float]] = []
        letters = [(c, 0.0)] if c.isalpha() else [(x, SUBSTITUTE) for x in LEET.get(c, "")]
        for x, cost in letters:
            if run == 1:
                out.append((x, cost))
            elif run == 2:
                out += [(x + x, cost), (x, cost + HALVE)]
            else:
                out += [(x, cost + SHORTEN), (x + x, cost + SHORTEN)]
        if c in SEPARATORS:
            out += [("", DROP), (" ", EDGE if edge else KEEP)]
        elif not c.isalpha():
            out.append((" ", KEEP * (1 + c.isdigit())))
        return out

    def restore(self, word: str) -> str:
        best = {(0, 0): (0.0, "")}
        i = 0
        while i < len(word):
            j = i + 1
            while j < len(word) and word[j] == word[i]:
                j += 1
            new: dict = {}
            choices = self.options(word[i], j - i, word[i] == " " and (i == 1 or j == len(word) - 1))
            i = j
            for (p, q), (cost, done) in best.items():
                for text, extra in choices:
                    a, b, total = p, q, cost + extra
                    for x in text:
                        s = self.symbol(x)
                        if not (s == 0 and b == 0):
                            total += self.cost[a][b][s]
                            a, b = b, s
                    have = new.get((a, b))
                    if have is None or total < have[0]:
                        new[(a, b)] = (total, done + text)
            best = new
        return min((cost + self.cost[p][q][0], done) for (p, q), (cost, done) in best.items())[1]


def features(word: str) -> list[str]:
    """The word and its beginnings."""
    return [word, *(word[:n] + "~" for n in BEGINNINGS if len(word) >= n)]


class Reader:
    """Distinct restored words of a text, by way of what each raw word stands for."""

    def __init__(self, decoder: Decoder, of):
        self.decoder, self.of, self.seen = decoder, of, {}

    def word(self, raw: str):
        low = raw.lower()
        words = [low.strip(EDGES)]
        if DISGUISED.search(low):
            words += self.decoder.restore(low.rstrip(EDGES)).split()
        return self.of(words)

    def text(self, text: str) -> list:
        got = []
        seen = self.seen
        for raw in set(text.split()):
            have = seen.get(raw, seen)
            if have is seen:
                if len(seen) >= REMEMBERED:
                    seen.clear()
                have = seen[raw] = self.word(raw)
            if have:
                got.append(have)
        spaced = {m.group() for m in SPACED.finditer(text)} | {" ".join(m.group().split()) for m in WIDE.finditer(text)}
        for found in spaced:
            have = self.of(self.decoder.restore(found.lower()).split())
            if have:
                got.append(have)
        return got


def train(docs: DataFrame, labels: DataFrame, decoder: Decoder, fit: Column, rows: int = LABELLED_ROWS, epochs: int = EPOCHS) -> dict[str, float]:
    """Weights by feature, the bias under the empty one. The sample is of bounded rows, so its ids are broadcast and its features gathered."""
    sent = docs.sparkSession.sparkContext.broadcast(decoder)
    chosen = docs.select("doc_id", "text").join(F.broadcast(sampled(labels, "toxic", fit, rows)), "doc_id").select("text", "label", "doc_id")

    def run(batches):
        reader = Reader(sent.value, lambda words: [f for w in words if w for f in features(w)])
        for b in batches:
            found = [sorted({f for have in reader.text(t or "") for f in have}) for t in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(1).cast(pa.int32()), b.column(2).cast(pa.int64()), pa.array([" ".join(f) for f in found])], ["label", "doc_id", "found"])

    got = sorted(chosen.mapInArrow(run, "label int, doc_id long, found string").toArrow().to_pylist(), key=lambda r: (r["doc_id"], r["found"]))
    places: dict[str, int] = {"": 0}
    rows_ = [(r["label"], np.array([0, *(places.setdefault(f, len(places)) for f in r["found"].split())], np.int64)) for r in got]
    seen = np.zeros((2, len(places)))
    for y, at in rows_:
        seen[y, at] += 1
    total = seen.sum(axis=0)
    base = (seen[1, 0] + 0.5) / (total[0] + 1) if rows_ else 0.5
    rate = seen[1] / np.maximum(total, 1)
    ratio = 2 * (seen[1] * np.log(np.maximum(rate, 1e-9) / base) + seen[0] * np.log(np.maximum(1 - rate, 1e-9) / (1 - base)))
    learned = (rate > base) & (ratio >= EVIDENCE)
    learned[0] = True
    rows_ = [(y, at[learned[at]]) for y, at in rows_]
    model = Ftrl(len(places), alpha=1.0, l1=0.1)
    for _ in range(epochs):
        for i in np.random.default_rng(7).permutation(len(rows_)):
            y, at = rows_[i]
            model.learn(at, np.ones(len(at)), y)
    w = model.weights()
    return {f: float(w[i]) for f, i in places.items() if w[i]}


def score(docs: DataFrame, decoder: Decoder, weights: dict[str, float], text: str = "text", out: str = "score") -> DataFrame:
    """docs with a double column out from 0 to 1; null and empty texts get the bias alone. A column of that name is replaced.

    Rows are kept, repeated ones too, with all other columns; texts of any length are read whole; an empty table gives an empty one.
    """
    sent = docs.sparkSession.sparkContext.broadcast((decoder, weights))  # a table of fixed size, and what a bounded sample taught

    def make():
        coder, w = sent.value
        bias = w.get("", 0.0)
        reader = Reader(coder, lambda words: tuple(f for x in words if x for f in features(x) if f in w))

        def f(texts):
            total = [bias + sum(w[f] for f in {f for have in reader.text(t) for f in have}) for t in texts.to_pylist()]
            return [pa.array(1 / (1 + np.exp(-np.clip(np.array(total), -700, 700))))]

        return f

    return shared.extended(docs, text, make, f"{out} double")


def restore(docs: DataFrame, decoder: Decoder, text: str = "text", out: str = "restored") -> DataFrame:
    """docs with the restored text: disguised words replaced by their decoding, lower case, all else as it is. Null texts become empty."""
    sent = docs.sparkSession.sparkContext.broadcast(decoder)

    def make():
        coder = sent.value

        def word(raw: str) -> str:
            low = raw.lower().rstrip(EDGES)
            got = coder.restore(low) if DISGUISED.search(raw.lower()) else low
            return raw if got == low else got

        def one(t: str) -> str:
            for pattern in (SPACED, WIDE):
                t = pattern.sub(lambda m: coder.restore(" ".join(m.group().lower().split())), t)
            return re.sub(r"\S+", lambda m: word(m.group()), t)

        return lambda texts: [pa.array([one(t) for t in texts.to_pylist()], pa.string())]

    return shared.extended(docs, text, make, f"{out} string")


def op4_toxicity(spark, sf_dir: str) -> DataFrame:
    """Score of each document for toxicity; a null or empty text gets the bias alone."""
    shared.tune(spark)
    docs = shared.read(spark, sf_dir, "documents").select("doc_id", "text")
    decoder = Decoder(character_counts(docs, "text"))
    weights = train(docs, shared.read(spark, sf_dir, "labels"), decoder, remainder(5) != 0)
    return score(docs, decoder, weights).select("doc_id", (remainder(5) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
