import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from kmerdex.operators import index as X
from kmerdex.operators import mst, query, stats, tables, validate

from . import brute

K = 5


@pytest.fixture(scope="module")
def data(spark):
    rows = brute.sample_reads()
    reads = spark.createDataFrame(rows, "sample string, seq string")
    return rows, reads, X.index_reads(reads, K)


@pytest.fixture(scope="module")
def asked(spark):
    rows = brute.sample_reads(seed=1)
    rnd = random.Random(9)
    qs = [rows[1][1], rows[7][1][:30], brute.revcomp(rows[0][1].replace("N", "A")), brute.sequence(rnd, 50), "ACG", "", "ACGTN", "AAAAAAAAAAAA"]
    return qs, spark.createDataFrame(list(enumerate(qs)), "qid long, seq string")


def test_sets_and_ids(data):
    rows, _, index = data
    want = brute.sets(rows, K)
    names = {r["sample_id"]: r["sample"] for r in index.experiments.collect()}
    assert sorted(names.items()) == list(enumerate(sorted({s for s, _ in rows})))
    classes = {r["color_id"]: frozenset(names[i] for i in r["samples"]) for r in index.color_classes.collect()}
    assert len(set(classes.values())) == len(classes)
    got = {r["kmer"]: classes[r["color_id"]] for r in index.dbg.collect()}
    assert got == {w: frozenset(s) for w, s in want.items()}
    sizes = [r["abundance"] for r in index.color_classes.orderBy("color_id").collect()]
    assert sizes == sorted(sizes, reverse=True)
    assert [r["color_id"] for r in index.color_classes.orderBy("color_id").collect()] == list(range(len(sizes)))
    assert X.repeated_keys(index).isEmpty()
    assert tuple(X.cardinality(index).first()) == (len(want), len(classes), 4)


def test_many_samples(spark, data, monkeypatch):
    rows, reads, index = data
    monkeypatch.setattr(X, "BIT_SAMPLES", 0)
    other = X.index_reads(reads, K)
    for t in ("dbg", "color_classes"):
        assert sorted(map(str, getattr(other, t).collect())) == sorted(map(str, getattr(index, t).collect()))
    monkeypatch.setattr(X, "BIT_SAMPLES", 992)
    wide = [(f"s{i:03}", "ACGTACCATT" if i % 50 else "ACGTA") for i in range(130)]
    wide = X.index_reads(spark.createDataFrame(wide, "sample string, seq string"), K)
    assert sorted(len(r["samples"]) for r in wide.color_classes.collect()) == [127, 130]


def test_counts_and_cutoff(data, spark):
    rows, reads, _ = data
    want = Counter((s, w) for s, seq in rows for w in brute.kmers(seq, K))
    got = {(r["sample_id"], r["kmer"]): r["count"] for r in X.count_kmers(reads, K, sample="sample").collect()}
    assert got == want
    assert X.count_kmers(reads, K, sample="sample", cutoff=2).count() == sum(n > 1 for n in want.values())


def test_no_samples(spark):
    with pytest.raises(ValueError):
        X.index_reads(spark.createDataFrame([], "sample string, seq string"), K)


@pytest.mark.parametrize("k", [K, K + 1, K + 4])
def test_query(data, asked, k):
    rows, _, index = data
    found = brute.sets(rows, K)
    names = {r["sample_id"]: r["sample"] for r in index.experiments.collect()}
    got = {(r["qid"], names[r["sample_id"]]): r["n"] for r in query.query(index, asked[1], k).collect()}
    want = Counter()
    for i, q in enumerate(asked[0]):
        for big in set(brute.kmers(q, k)):
            for s in set(names.values()):
                want[i, s] += all(s in found.get(w, ()) for w in brute.kmers(big, K))
    assert got == {key: n for key, n in want.items() if n}


def test_query_sizes_and_small_k(data, asked):
    _, _, index = data
    got = {r["qid"]: r["num_kmers"] for r in query.num_kmers(asked[1], K).collect()}
    assert got == {i: len(set(brute.kmers(q, K))) for i, q in enumerate(asked[0])}
    with pytest.raises(ValueError):
        query.query(index, asked[1], K - 1)


def test_validation(data, asked, spark):
    _, reads, index = data
    ids = reads.join(index.experiments, "sample")
    from kmerdex.functions.kmers import kmers

    sk = kmers(ids, "seq", K, "sample_id").select("sample_id", "kmer")
    assert validate.validate(index, sk, asked[1]).isEmpty()
    assert not validate.validate(index, sk.where("sample_id > 0"), asked[1]).isEmpty()


@pytest.fixture(scope="module")
def weighted(data):
    index = data[2]
    return tables.stored(mst.weighted_edges(mst.color_edges(index), index.color_classes))


def test_edges_and_weights(data, weighted):
    index = data[2]
    color = {r["kmer"]: r["color_id"] for r in index.dbg.collect()}
    sets = {r["color_id"]: set(r["samples"]) for r in index.color_classes.collect()} | {mst.ROOT: set()}
    want = {tuple(sorted((color[w], color[n]))) for w in color for n in brute.neighbors(w) if n in color and color[n] != color[w]} | {(mst.ROOT, c) for c in sets if c != mst.ROOT}
    assert {(r["u"], r["v"], r["w"]) for r in weighted.collect()} == {(u, v, len(sets[u] ^ sets[v])) for u, v in want}


def test_tree(data, weighted):
    index = data[2]
    want = brute.kruskal([tuple(r) for r in weighted.collect()])
    small = mst.spanning_tree(weighted)
    large = mst.spanning_tree(weighted, driver_edges=1)
    assert {tuple(r) for r in small.collect()} == {tuple(r) for r in large.collect()} == set(want)
    assert {tuple(r) for r in mst.rooted_tree(weighted, driver_edges=1).collect()} == {tuple(r) for r in mst.rooted_tree(weighted).collect()}
    tree = tables.stored(mst.encode(index))
    assert tree.count() == index.color_classes.count()
    assert tree.agg(F.sum("weight")).first()[0] == sum(w for _, _, w in want)
    assert tree.where(F.size("delta") != F.col("weight")).isEmpty()
    assert validate.validate_mst(index, tree).isEmpty()


def test_query_through_tree(data, asked):
    index = data[2]
    a = query.query(index, asked[1]).collect()
    tree = tables.stored(mst.encode(index))
    met = query.touched(index, asked[1])
    for classes in (mst.decode(tree), mst.decode(tree, met)):
        b = query.query(index, asked[1], classes=classes).collect()
        assert sorted(map(tuple, a)) == sorted(map(tuple, b))
    none = asked[1].limit(0)
    assert query.query(index, none, classes=mst.decode(tree, query.touched(index, none))).count() == 0


def test_ways_to_the_root(spark):
    # a path of 20 colors beside a star; color n of the path has n + 1 above it, the root included
    rows = [(i, i - 1 if i else mst.ROOT, 1, [i]) for i in range(20)] + [(i, mst.ROOT, 1, [i]) for i in range(50, 60)]
    tree = spark.createDataFrame(rows, "color_id long, parent_id long, weight int, delta array<int>")
    for wanted, want in (([13], set(range(14))), ([0], {0}), ([55, 4, 2], {0, 1, 2, 3, 4, 55}), ([], set()), ([99, None], set())):
        colors = spark.createDataFrame([(c,) for c in wanted + wanted], "color_id long")
        assert sorted(r["color_id"] for r in mst.ways(tree, colors).collect()) == sorted(want)
    decoded = {r["color_id"]: r["samples"] for r in mst.decode(tree, spark.createDataFrame([(7,), (55,)], "color_id long")).collect()}
    assert decoded[7] == list(range(8)) and decoded[55] == [55] and len(decoded) == 9


def test_statistics(data):
    _, _, index = data
    color = {r["kmer"]: r["color_id"] for r in index.dbg.collect()}
    sets = {r["color_id"]: r["samples"] for r in index.color_classes.collect()}
    assert {r["color_id"]: r["count"] for r in stats.stats(index, "color_dist").collect()} == Counter(color.values())
    want = Counter((s, i + 1) for c in color.values() for i, s in enumerate(sets[c]))
    assert {(r["sample_id"], r["place"]): r["count"] for r in stats.stats(index, "cc_density").collect()} == want
    comp = brute.groups(color, [(w, n) for w in color for n in brute.neighbors(w) if color.get(n) == color[w]])
    assert {r["kmer"]: r["component"] for r in stats.monochromatic(index).collect()} == comp
    sizes = Counter(Counter(comp.values()).values())
    assert {r["size"]: r["components"] for r in stats.stats(index, "mono").collect()} == sizes
    j = 4
    known = {x for w in color for x in brute.kmers(w, j)}
    near = {x: {brute.canonical(x[:-1] + b) for b in "ACGT"} | {brute.canonical(b + x[1:]) for b in "ACGT"} for x in known}
    bad = {x for x in known if (near[x] - {x}) & known}
    assert {r["kmer"]: r["confused"] for r in stats.stats(index, "jmerkmer", j).collect()} == {w: bool(set(brute.kmers(w, j)) & bad) for w in color}
    with pytest.raises(ValueError):
        stats.stats(index, "other")


def test_numbering(spark):
    df = spark.range(1000).select(((F.col("id") * 7919) % 1000).alias("x")).repartition(5)
    assert all(r["x"] == r["n"] for r in tables.numbered(df, "n", F.col("x")).collect())
    assert tables.numbered(df.limit(0), "n", F.col("x")).count() == 0


def test_one_sample(spark):
    index = X.index_reads(spark.createDataFrame([("only", "ACGTACCATT")], "sample string, seq string"), K)
    assert index.color_classes.count() == 1
    assert [tuple(r)[1:3] for r in mst.encode(index).collect()] == [(mst.ROOT, 1)]


def test_damaged_tree(spark):
    index = X.index_reads(spark.createDataFrame(brute.sample_reads(), "sample string, seq string"), 5)
    tree = mst.encode(index)
    assert validate.validate_mst(index, tree).isEmpty()
    damaged = tree.withColumn("delta", F.when(F.col("color_id") == 0, F.slice("delta", 2, 100)).otherwise(F.col("delta")))
    wrong = {r["color_id"] for r in validate.validate_mst(index, damaged).collect()}
    below = {0}
    for _ in range(index.color_classes.count()):
        below |= {r["color_id"] for r in tree.collect() if r["parent_id"] in below}
    assert wrong == below


@pytest.mark.parametrize("shape", ["path", "star", "random", "none"])
def test_rooting(spark, shape):
    draw = random.Random(3)
    n = 0 if shape == "none" else 200
    above = {v: {"path": v - 1, "star": -1, "random": draw.randrange(-1, v)}[shape] for v in range(n)}
    name = {-1: -1} | dict(zip(range(n), draw.sample(range(n), n)))  # a parent's id may be the larger one
    expected = {(name[v], name[u], v % 7) for v, u in above.items()}
    edges = [(min(a, b), max(a, b), w) for a, b, w in expected] + [(1000, 1001, 1), (1001, 1002, 1)] * (n > 0)  # the last are not joined to the root
    got = mst.rooted(spark.createDataFrame(edges, "u long, v long, w int")).collect()
    assert len(got) == n and {tuple(r) for r in got} == expected
