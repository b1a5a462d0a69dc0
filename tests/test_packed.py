import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from kmerdex.functions import kmers as K
from kmerdex.functions import packed as P
from kmerdex.operators import index as X
from kmerdex.operators import query, tables
from kmerdex.plans import queries as Q
from kmerdex.sources import fixtures as fx

from . import brute


def sequences():
    rnd = random.Random(5)
    return [brute.sequence(rnd, n) for n in (0, 3, 11, 12, 40, 300)] + ["ACGTN", "NACGTACGTACGTN", "acgtacgtacgtacgt", "AÇGTACGTACGTéNACG", "A" * 40, None, ""]


@pytest.mark.parametrize("size", [1, 50, 1 << 20])
def test_numbers_are_those_of_the_words(spark, monkeypatch, size):
    monkeypatch.setattr(P, "SLICE", size)
    df = spark.createDataFrame(list(enumerate(sequences())), "id int, seq string").repartition(2)
    for k in (1, 2, 7, 16, 21, 31):
        words = K.kmers(df, "seq", k, "id").select("id", "kmer")
        want = words.groupBy("id").agg(F.count("*"), F.countDistinct("kmer"), *[K.pack(f("kmer")).cast("long") for f in (F.min, F.max)])
        assert sorted(map(tuple, P.summed(df, "seq", k, "id").collect())) == sorted(map(tuple, want.collect()))
        asked = words.where("id <> 5").select("kmer").distinct()
        assert sorted(map(tuple, P.among(df, "seq", k, asked, "id").collect())) == sorted(map(tuple, words.join(asked, "kmer", "left_semi").select("id", "kmer").collect()))


def test_words_beyond_a_number(spark, monkeypatch):
    df = spark.createDataFrame([(0, "ACGT" * 20), (1, "AACC" * 20)], "id int, seq string")
    asked = K.kmers(df.where("id = 1"), "seq", 33).select("kmer").distinct()
    for most in (0, 100):  # joined or broadcast
        monkeypatch.setattr(P, "BROADCAST_WORDS", most)
        assert P.among(df, "seq", 33, asked, "id").groupBy("id").count().collect() == [(1, 48)]
        assert P.among(df, "seq", 9, asked.select(F.substring("kmer", 1, 9).alias("kmer")), "id").where("id = 0").isEmpty()
    with pytest.raises(ValueError):
        P.summed(df, "seq", 32, "id")


def test_kmer_extract_sends_no_window_around(spark, tmp_path):
    rnd = random.Random(3)
    rows = [(i, "".join(rnd.choice("abcdefgh XYZé\n") for _ in range(rnd.randint(0, 900)))) for i in range(60)] + [(None, "no id " * 20), (99, None), (98, "short")]
    spark.createDataFrame(rows, "doc_id long, text string").repartition(8).write.parquet(f"{tmp_path}/documents.parquet")
    got = Q.kmer_extract(spark, str(tmp_path))
    got.collect()
    assert "hashpartitioning" not in got._jdf.queryExecution().executedPlan().toString()


def test_kmer_extract_of_repeated_ids_and_long_texts(spark, tmp_path, monkeypatch):
    rnd = random.Random(4)
    rows = [(i % 50, "".join(rnd.choice("abcdefgh ijk lm\n") for _ in range(rnd.randint(0, 600)))) for i in range(70)] + [(None, "a line of no id " * 3), (None, "a line of no id " * 9), (60, "ab" * 900), (61, None)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    d = fx.table(spark, str(tmp_path), "documents").select("doc_id", fx.bases(F.col("text")).alias("seq"))
    want = set(map(tuple, K.kmers(d, "seq", Q.DOCS_K, "doc_id").groupBy("doc_id").agg(F.count("*"), F.countDistinct("kmer"), F.min("kmer"), F.max("kmer")).collect()))
    assert len(want) > 30
    for long in (Q.LONG_TEXT, 1000, 0):
        monkeypatch.setattr(Q, "LONG_TEXT", long)
        got = Q.kmer_extract(spark, str(tmp_path))
        assert got.columns == ["doc_id", "n_windows", "n_kmers", "least", "greatest"]
        assert got.count() == len(want) and set(map(tuple, got.collect())) == want


def test_an_index_of_given_words_answers_like_the_whole(spark):
    rnd = random.Random(8)
    reads = [(f"s{i % 7}", brute.sequence(rnd, 60)) for i in range(40)] + [("none", "ACG"), (None, "ACGTACGTACGT")]
    asked = spark.createDataFrame([(i, reads[3 * i][1][5:40]) for i in range(9)] + [(9, "N"), (10, "A" * 20)], "qid int, seq string")
    df = spark.createDataFrame(reads, "sample string, seq string")
    words = query.query_kmers(asked, 5).select("kmer").distinct()
    for cutoff in (1, 3):
        whole, part = X.index_reads(df, 5, cutoff=cutoff), X.index_reads(df, 5, cutoff=cutoff, only=words)
        want = sorted(map(tuple, query.query(whole, asked).collect()))
        assert want and sorted(map(tuple, query.query(part, asked).collect())) == want
        assert sorted(map(tuple, query.query(part, asked, 9).collect())) == sorted(map(tuple, query.query(whole, asked, 9).collect()))
        assert part.dbg.count() < whole.dbg.count() and part.experiments.count() == whole.experiments.count()


def test_validate_index_writes_no_word_that_is_not_asked_for(spark, tmp_path):
    rnd = random.Random(6)
    texts = ["".join(rnd.choice("abcdefgh") for _ in range(400)) for _ in range(40)]
    spark.createDataFrame([(t, f"s{i % 3}") for i, t in enumerate(texts)] + [(None, "s0"), (texts[0], None)], "text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, t[:60]) for i, t in enumerate(texts[:5])] + [(9, None)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    before = set(Path(tables.folder(spark)).glob("sets-*"))
    found = {(r["qid"], r["sample_id"]): (r["expected"], r["found"]) for r in Q.validate_index(spark, str(tmp_path)).collect()}
    made = set(Path(tables.folder(spark)).glob("sets-*")) - before
    assert 0 < sum(spark.read.parquet(str(p)).count() for p in made) <= 5 * 40
    asked = K.kmers(fx.questions(spark, str(tmp_path)), "seq", Q.DOCS_K, "qid").collect()
    for q in range(5):
        words = {r["kmer"] for r in asked if r["qid"] == q}
        left = sum(not w.startswith("G") for w in words)
        assert len(words) == 40 and found.get((q, q % 3)) == (None if left == 40 else (40, left or None))
