import random

import pytest
from pyspark.sql import functions as F

from kmerdex.functions import kmers as K

from . import brute


def rows(spark, data, ddl):
    return spark.createDataFrame(data, ddl)


def test_windows_equal_brute_force(spark):
    rnd = random.Random(5)
    seqs = [brute.sequence(rnd, n) for n in (0, 3, 11, 12, 40, 300)] + ["ACGTN", "NACGTACGTACGTN", "acgtacgtacgtacgt", "ACGTACGTACGTNACG", "A" * 30, None]
    for k in (4, 11):
        got = K.kmers(rows(spark, list(enumerate(seqs)), "id int, seq string"), "seq", k, "id").collect()
        for i, s in enumerate(seqs):
            assert sorted(r["kmer"] for r in got if r["id"] == i) == sorted(brute.kmers(s or "", k))


def test_a_sequence_and_its_reverse_complement_are_alike(spark):
    s = brute.sequence(random.Random(2), 90, 0)
    a, b = (sorted(r["kmer"] for r in K.kmers(rows(spark, [(x,)], "seq string"), "seq", 9).collect()) for x in (s, brute.revcomp(s)))
    assert a == b


def test_k_must_be_positive(spark):
    with pytest.raises(ValueError):
        K.kmers(rows(spark, [("ACGT",)], "seq string"), "seq", 0)


def test_pack_and_unpack(spark):
    words = ["C", "G", "CATG", "GGGG", "A" * 31, "G" * 31]
    got = rows(spark, [(w, len(w)) for w in words], "w string, n int").select("w", K.pack(F.col("w")).cast("long").alias("p")).collect()
    assert [r["p"] for r in got] == [int("".join(str(brute.ORDER[c]) for c in w), 4) for w in words]
    assert rows(spark, [(27,)], "p long").select(K.unpack(F.col("p"), 5)).first()[0] == "CCATG"
    assert rows(spark, [("G" * 32,)], "w string").select(K.pack(F.col("w"))).first()[0] == 2**64 - 1


@pytest.mark.parametrize("word,period", [("AAAA", 1), ("ACAC", 2), ("ACGACG", 3), ("ACGT", 4), ("ACA", 2), ("A", 1)])
def test_period(spark, word, period):
    assert rows(spark, [(word,)], "w string").select(K.period(F.col("w"))).first()[0] == period


def test_neighbors_and_palindromes(spark):
    words = sorted({brute.canonical(w) for w in ("ACGT", "AAAA", "ACGA", "TTGC", "CATG", "GATC")})
    got = K.neighbors(rows(spark, [(w,) for w in words], "w string"), "w").collect()
    for w in words:
        near = [r["neighbor"] for r in got if r["kmer"] == w]
        assert len(near) == len(set(near)) and set(near) == brute.neighbors(w)


def test_affixes_and_parts(spark):
    w = F.col("w")
    r = rows(spark, [("ACGTT", "a/b/c")], "w string, p string").select(
        K.prefix(w, 2), K.suffix(w, 2), K.extend_right(w, F.lit("C")), K.extend_left(w, F.lit("C")), K.first_part(F.col("p"), "/"), K.last_part(F.col("p"), "/"), K.is_valid(w), K.is_valid(F.lit("ACN"))
    )
    assert tuple(r.first()) == ("AC", "TT", "CGTTC", "CACGT", "a", "c", True, False)


def test_sql_functions(spark):
    K.register(spark)
    assert spark.sql("SELECT canonical_kmer('ACCT'), reverse_complement('ACCT')").first()[:] == (brute.canonical("ACCT"), "AGGT")


def test_long_runs_are_cut(spark, monkeypatch):
    words = K.random_words(spark, 3, 400, seed=5)
    assert [r["word"] for r in words.collect()] == [r["word"] for r in K.random_words(spark, 3, 400, seed=5).repartition(3).orderBy("id").collect()]
    df = words.select("id", F.concat("word", F.lit("N"), F.substring("word", 1, 37)).alias("seq"))
    whole = sorted(map(tuple, K.kmers(df, "seq", 9, "id").collect()))
    for piece in (1, 8, 391, 392, 393):
        monkeypatch.setattr(K, "PIECE", piece)
        assert sorted(map(tuple, K.kmers(df, "seq", 9, "id").collect())) == whole
    assert len(whole) == 3 * (392 + 29)


def test_words_too_long_to_pack(spark):
    df = spark.createDataFrame([("ACGT" * 8,), (None,)], "w string")
    assert [r["p"] for r in df.select(K.pack(F.col("w")).alias("p")).collect()][1] is None
    with pytest.raises(Exception, match="32 bases"):
        spark.createDataFrame([("A" * 33,)], "w string").select(K.pack(F.col("w"))).collect()
