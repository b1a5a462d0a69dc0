from collections import Counter

import pytest

from kmerdex.operators import multiset as M

A = {"AA": 3, "AC": 1, "CC": 5}
B = {"AC": 4, "CC": 5, "GG": 2}


@pytest.fixture(scope="module")
def ab(spark):
    return [spark.createDataFrame(list(x.items()), "kmer string, count long") for x in (A, B)]


def out(df):
    return {r["kmer"]: r["count"] for r in df.collect()}


def test_algebra(ab, spark):
    a, b = ab
    assert out(M.merge(a, b)) == Counter(A) + Counter(B)
    assert out(M.merge(a, b, a)) == Counter(A) + Counter(B) + Counter(A)
    assert out(M.intersect(a, b)) == {"AC": 1, "CC": 5}
    assert M.inner_product(a, b).first()[0] == 1 * 4 + 5 * 5
    assert M.magnitude(a).first()[0] == 5
    assert out(M.remove(a, b)) == {"AA": 3}
    assert out(M.delete(a, b)) == {"AA": 3}
    assert out(M.lookup(a, b)) == {"AC": 1, "CC": 5, "GG": 0}
    assert out(M.set_count(a, spark.createDataFrame([("AA", 9), ("TT", 1), ("CC", 0)], "kmer string, count long"))) == {"AA": 9, "AC": 1, "CC": 5, "TT": 1}
    assert out(M.insert(a, spark.createDataFrame([("AA", 0), ("TT", 0)], "kmer string, count long"))) == A
    assert tuple(M.totals(a).first()) == (3, 9, 5)
    assert out(M.key_range(a, "AC", "CC")) == {"AC": 1}


def test_empty(ab):
    a, _ = ab
    none = a.limit(0)
    assert M.inner_product(a, none).first()[0] == 0 and M.magnitude(none).first()[0] == 0
    assert out(M.merge(none, none)) == {} and out(M.merge(a, none)) == A
    assert tuple(M.totals(none).first()) == (0, 0, 0)
