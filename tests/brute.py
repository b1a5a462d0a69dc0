"""Plain Python versions, for small inputs."""

import random
from collections import Counter, defaultdict

ORDER = {b: i for i, b in enumerate("CATG")}
OTHER = {"A": "T", "T": "A", "C": "G", "G": "C"}


def revcomp(w):
    return "".join(OTHER[c] for c in reversed(w))


def canonical(w):
    return max(w, revcomp(w), key=lambda x: [ORDER[c] for c in x])


def kmers(seq, k):
    out, run = [], ""
    for c in seq + "N":
        if c in ORDER:
            run += c
        else:
            out += [canonical(run[i : i + k]) for i in range(len(run) - k + 1)]
            run = ""
    return out


def neighbors(w):
    return {canonical(w[1:] + b) for b in "ACGT"} | {canonical(b + w[:-1]) for b in "ACGT"}


def sequence(rnd, n, breaks=0.02):
    return "".join("N" if rnd.random() < breaks else rnd.choice("ACGT") for _ in range(n))


def sample_reads(seed=1, samples=4, reads=6, length=60):
    rnd = random.Random(seed)
    common = [sequence(rnd, length) for _ in range(3)]
    return [(f"s{i}", rnd.choice(common) if j % 2 else sequence(rnd, length)) for i in range(samples) for j in range(reads)]


def sets(rows, k):
    found = defaultdict(set)
    for s, seq in rows:
        for w in kmers(seq, k):
            found[w].add(s)
    return found


def kruskal(edges):
    top = {}

    def find(x):
        while top.setdefault(x, x) != x:
            x = top[x]
        return x

    out = []
    for w, u, v in sorted((w, u, v) for u, v, w in edges):
        if find(u) != find(v):
            top[find(u)] = find(v)
            out.append((u, v, w))
    return out


def groups(nodes, pairs):
    top = {n: n for n in nodes}

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        top[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def counter(words):
    return Counter(words)
