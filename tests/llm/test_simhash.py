import random
import re

import numpy as np
import xxhash

from kmerdex.llm import simhash as S

from . import data


def fingerprint(t, n=3):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), t or ""))
    s = [" ".join(w[i : i + n]) for i in range(len(w) - n + 1)] if len(w) >= n else [" ".join(w)] if w else []
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def grouped(fps, bits):
    top = list(range(len(fps)))

    def find(i):
        while top[i] != i:
            i = top[i]
        return i

    a = np.array(fps, np.uint64)
    for i in range(len(a)):
        for j in np.flatnonzero(np.bitwise_count(a[:i] ^ a[i]) <= bits):
            x, y = find(i), find(int(j))
            top[max(x, y)] = min(x, y)
    return [find(i) for i in range(len(a))]


def test_fingerprints(spark):
    docs = data.documents(spark)
    got = S.fingerprints(docs).select("doc_id", "text", "fp", "score").collect()
    assert len(got) == docs.count()
    for r in got:
        if len(r["text"] or "") < 20_000:
            assert r["fp"] == signed(fingerprint(r["text"]))


def test_near_fingerprints_join(spark):
    rnd = random.Random(6)
    fps = [0]
    for _ in range(60):
        x = rnd.getrandbits(64)
        for _ in range(8):
            fps.append(x)
            for b in rnd.sample(range(64), rnd.randint(1, 5)):
                x ^= 1 << b
    df = spark.createDataFrame([(i, signed(x)) for i, x in enumerate(fps)] + [(3, signed(fps[3]))], "doc_id long, fp long")
    want = grouped(fps, 3)
    assert {r["doc_id"]: r["component_id"] for r in S.classes(df).collect()} == dict(enumerate(want))
    assert S.classes(df).count() == len(fps) + 1
    assert S.classes(df.limit(0)).count() == 0


def test_one_crowded_anchor():
    rnd = random.Random(8)
    base = rnd.getrandbits(64)
    fps = sorted({base ^ sum(1 << b for b in rnd.sample(range(64), rnd.randint(0, 6))) for _ in range(3000)})
    a, b = S.linked(np.zeros(len(fps), np.int64), np.array(fps, np.uint64), 3)
    at = {x: i for i, x in enumerate(fps)}
    want = grouped(fps, 3)
    got = list(range(len(fps)))
    for x, y in zip(a.tolist(), b.tolist()):
        got[at[x]] = at[y]
    assert got == want


def test_crowded_anchors_are_dealt_into_parts(spark):
    rnd = random.Random(9)
    base = rnd.getrandbits(64)
    fps = sorted({base ^ sum(1 << b for b in rnd.sample(range(64), rnd.randint(0, 7))) for _ in range(1500)})
    df = spark.createDataFrame([(signed(x),) for x in fps], "fp long")
    at = {signed(x): i for i, x in enumerate(fps)}
    want = grouped(fps, 3)
    assert 1 < len(set(want)) < len(fps)
    for crowd in (S.CROWD, 150):
        label = list(range(len(fps)))
        pairs = [(at[r["a"]], at[r["b"]]) for r in S.links(df, crowd=crowd).collect()]
        moved = True
        while moved:
            moved = False
            for a, b in pairs:
                low = min(label[a], label[b])
                if (label[a], label[b]) != (low, low):
                    label[a] = label[b] = low
                    moved = True
        assert label == want


def test_distinct(spark):
    rnd = random.Random(2)
    w = data.vocabulary(rnd, 300)
    rows, n = [], 0
    groups = []
    for g in range(8):
        base = [rnd.choice(w) for _ in range(200)]
        ids = []
        for c in range(4):
            t = list(base)
            for _ in range(c % 3):
                t[rnd.randrange(200)] = rnd.choice(w)
            rows.append((n, " ".join(t), f"x{n}"))
            ids.append(n)
            n += 1
        groups.append(ids)
    rows += [(n, None, "null"), (n + 1, "", "empty"), (None, "alone", "no id"), (n + 2, "short text", "a"), (n + 3, "short test", "b"), (0, rows[0][1], "x0")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, id string")
    got = S.distinct(docs)
    ids = [r["doc_id"] for r in got.collect()]
    assert got.columns == docs.columns
    assert sorted(i for i in ids if i is not None) == sorted([0, 0, *(g[0] for g in groups[1:]), n, n + 2, n + 3]) and None in ids
    assert S.distinct(docs.limit(0)).count() == 0
