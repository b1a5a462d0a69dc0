"""The classifiers' scores and the decoder's search against plain Python that neither hashes nor prunes."""

import itertools
import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest

from kmerdex.llm import quality, toxicity


def form(words, i):
    """Letter case of a word, whether it repeats the one before, and the signs it ends with."""
    w = words[i]
    ups, lows = sum("A" <= c <= "Z" for c in w), sum("a" <= c <= "z" for c in w)
    size = len(w.encode())
    case = "no" if not ups else "mixed" if lows else "all" if size > 1 else "one"
    sign = lambda c: "" if c.isalnum() else c
    return case, i > 0 and words[i - 1] == w, sign(w[-1]), sign(w[-2]) if size > 1 else ""


def counted(text):
    words = (text or "").split()
    forms = [form(words, i) for i in range(len(words))]
    c = Counter()
    for kind, x in (("word", words), ("form", forms)):
        c.update((kind, a) for a in x)
        c.update((kind, a, b) for a, b in zip(x, x[1:]))
    size = math.sqrt(sum(n * n for n in c.values()))
    return {k: n / size for k, n in c.items()}


def follow(rows, epochs, alpha=0.5, beta=1.0, l1=0.002):
    """Weights by feature after follow-the-regularised-leader updates over rows (features, label)."""
    z, n = Counter(), Counter()

    def weight(k):
        return 0.0 if abs(z[k]) <= l1 else -(z[k] - math.copysign(l1, z[k])) / ((beta + math.sqrt(n[k])) / alpha)

    for _ in range(epochs):
        for i in np.random.default_rng(7).permutation(len(rows)):
            x, label = rows[i]
            x = x | {"bias": 1.0}
            w = {k: weight(k) for k in x}
            p = 1 / (1 + math.exp(-sum(w[k] * v for k, v in x.items())))
            for k, v in x.items():
                g = (p - label) * v
                z[k] += g - (math.sqrt(n[k] + g * g) - math.sqrt(n[k])) / alpha * w[k]
                n[k] += g * g
    return {k: weight(k) for k in n}


def test_quality_scores(spark):
    rnd = random.Random(2)
    words = ["Alpha", "beta!!", "GAMMA", "x", "X", "7.5", "über", "end.", "(so)", "so,", "delta", "delta"]
    rows = [(i, " ".join(rnd.choice(words) for _ in range(rnd.randint(1, 25)))) for i in range(90)] + [(90, None), (91, ""), (92, " \n")]
    labels = [(i, int("GAMMA" in (t or ""))) for i, t in rows if i % 10]
    label = dict(labels)
    learned = [(counted(t), label[i]) for i, t in rows if i in label and zlib.crc32(str(i).encode()) % 3 != 1]
    w = follow(learned, quality.EPOCHS)
    expected = {i: 1 / (1 + math.exp(-w["bias"] - sum(w.get(k, 0.0) * v for k, v in counted(t).items()))) for i, t in rows}
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    weights = quality.train(docs, spark.createDataFrame(labels, "doc_id long, quality int"), "quality", quality.remainder(3) != 1, places=1 << 22)
    got = {r["doc_id"]: r["score"] for r in quality.score(docs, weights).collect()}
    assert got == pytest.approx(expected, abs=1e-5)


def ends(word, i, j):
    return word[i] == " " and (i == 1 or j == len(word) - 1)


def all_readings(word):
    """(text, channel cost) of every path through the lattice of a word."""
    runs, i = [], 0
    for c, g in itertools.groupby(word):
        n = len(list(g))
        runs.append((c, n, ends(word, i, i + n)))
        i += n
    choices = []
    for c, n, edge in runs:
        to = []
        for x in [c] if c.isalpha() else toxicity.LEET.get(c, ""):
            cost = 0.0 if c.isalpha() else toxicity.SUBSTITUTE
            few = toxicity.SHORTEN if n > 2 else toxicity.HALVE if n == 2 else 0.0
            to.append((x, cost + few))
            if n > 1:
                to.append((x + x, cost + (toxicity.SHORTEN if n > 2 else 0.0)))
        if c in toxicity.SEPARATORS:
            to += [("", toxicity.DROP), (" ", toxicity.EDGE if edge else toxicity.KEEP)]
        elif not c.isalpha():
            to.append((" ", toxicity.KEEP * (2 if c.isdigit() else 1)))
        choices.append(to)
    for path in itertools.product(*choices):
        yield "".join(t for t, _ in path), sum(cost for _, cost in path)


def test_search_finds_the_best_of_all_paths():
    rnd = random.Random(4)
    counts = np.random.default_rng(4).integers(0, 60, (toxicity.SYMBOLS,) * 3).astype(float)
    decoder = toxicity.Decoder(counts)
    share = (counts + 0.05) / (counts + 0.05).sum(axis=2, keepdims=True)

    def cost(text, channel):
        s = [0, 0, *(ord(c) - 96 if c != " " else 0 for c in " ".join(text.split()) + " " * text[-1:].isspace() * bool(text.split())), 0]
        return channel - sum(math.log(share[a, b, c]) for a, b, c in zip(s, s[1:], s[2:]))

    for _ in range(400):
        word = "".join(rnd.choice("abst10!$.- ") * rnd.choice([1, 1, 2, 3]) for _ in range(rnd.randint(1, 6)))
        found = decoder.restore(word)
        cheapest = min(cost(*r) for r in all_readings(word))
        assert min(cost(t, c) for t, c in all_readings(word) if t == found) == pytest.approx(cheapest), word
