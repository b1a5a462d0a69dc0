import random

from kmerdex.llm import simhash as S

from . import data
from .test_simhash import fingerprint


def runs(t, n=5):
    w = t.lower().split()
    return {" ".join(w[i : i + n]) for i in range(len(w) - n + 1)} or ({" ".join(w)} if w else set())


def kept(texts, similarity=0.8):
    """Places that stay, by comparing all pairs."""
    sets = [runs(t) for t in texts]
    top = list(range(len(texts)))

    def find(i):
        while top[i] != i:
            i = top[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            if len(sets[i] & sets[j]) >= similarity * len(sets[i] | sets[j]) - 1e-12:
                x, y = find(i), find(j)
                top[max(x, y)] = min(x, y)
    return {i for i in range(len(texts)) if find(i) == i}


def templated(rnd, n=150, copies=20):
    """Texts of 225 shared and 75 own words, and near-copies of some."""
    w = data.vocabulary(rnd, 2000)
    shared = [rnd.choice(w) for _ in range(225)]
    texts = [shared + [rnd.choice(w) for _ in range(75)] for _ in range(n)]
    for i in rnd.sample(range(n), copies):
        t = list(texts[i])
        for k in rnd.sample(range(300), 6):
            t[k] = rnd.choice(w)
        texts.append(t)
    return [" ".join(t) for t in texts]


def test_near_copies_among_texts_of_one_template(spark):
    texts = templated(random.Random(4))
    want = kept(texts)
    assert 150 <= len(want) < 165
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r["doc_id"] for r in S.distinct(docs).collect()} == want


def test_parts_of_a_cluster(spark):
    texts = templated(random.Random(5), 60, 20) + ["", " ", "one", "One", "two words", "two Words"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for part in (1, 1500, 1 << 18):
        later = {r["a"]: r["b"] for r in S.shared.components(S.near_pairs(docs, 5, 0.8, part)).toDF("a", "b").where("a > b").collect()}
        assert set(range(len(texts))) - set(later) == kept(texts)


def test_near_copies_far_apart_in_bits(spark):
    rnd = random.Random(9)
    w = data.vocabulary(rnd, 3000)
    texts = []
    for k in range(120):
        t = [rnd.choice(w) for _ in range(200)]
        u = list(t)
        if k % 4 == 0:  # a repeated line
            u += [rnd.choice(w) for _ in range(8)] * 5
        elif k % 4 == 1:
            u += [rnd.choice(w) for _ in range(46)]
        elif k % 4 == 2:
            u[179:] = [rnd.choice(w) for _ in range(21)]
        else:
            for i in range(5, 200, 50):
                u[i] = "edited"
        texts += [t, u]
    texts = [" ".join(t) for t in texts]
    want = kept(texts)
    assert want == set(range(0, 240, 2))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r["doc_id"] for r in S.distinct(docs).collect()} == want


def test_texts_that_only_fingerprints_link(spark):
    """One line over and over rules the fingerprints of two texts that have little else in common."""
    rnd = random.Random(12)
    w = data.vocabulary(rnd, 5000)
    texts = []
    for _ in range(12):
        line = [rnd.choice(w) for _ in range(11)] * 40
        texts += [" ".join(line + [rnd.choice(w) for _ in range(400)]) for _ in range(2)]
    apart = [(fingerprint(texts[i]) ^ fingerprint(texts[i + 1])).bit_count() for i in range(0, 24, 2)]
    near = {2 * i for i, x in enumerate(apart) if x <= S.BITS}
    assert len(near) > 5 and any(apart[i // 2] for i in near)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r["doc_id"] for r in S.distinct(docs, similarity=0.01).collect()} == set(range(24)) - {i + 1 for i in near}
    assert S.distinct(docs).count() == 24  # the exact check follows


def test_texts_are_signed_once(spark, monkeypatch):
    """Fingerprints and bands come from one pass over the texts, and no pairs are written twice."""
    texts = templated(random.Random(6), 20, 5) + ["", "one", "one"]
    docs = spark.createDataFrame([*enumerate(texts), (99, None)], "doc_id long, text string")
    names, written = [], S.shared.written
    monkeypatch.setattr(S.shared, "written", lambda df, name: names.append(name) or written(df, name))
    got = {r["doc_id"] for r in S.distinct(docs).collect()}
    assert got == kept(texts)
    assert [n for n in names if n != "edges"] == ["first", "signs", "values", "crowded", "met", "sets"]
    signs = S.signed(docs, 5).collect()
    assert {r["id"]: r["fp"] % (1 << 64) for r in signs} == {i: fingerprint(t) for i, t in [*enumerate(texts), (99, "")]}
    assert all(len(r["keys"]) == S.BANDS for r in signs)
