import json
import struct

import pytest
from pyspark.sql import functions as F

from kmerdex.operators import index as X
from kmerdex.operators import mst, query
from kmerdex.sources import io
from kmerdex.streaming.query_stream import query_stream

from . import brute


def test_tokens_and_fasta(spark, tmp_path):
    (tmp_path / "list").write_text("b/x.dat  a/y.dat\n\nc\n")
    assert [tuple(r) for r in io.read_manifest(spark, str(tmp_path / "list")).orderBy("sample_id").collect()] == [(0, "b/x.dat"), (1, "a/y.dat"), (2, "c")]
    (tmp_path / "q").write_text("ACGT TTT\nGG\n")
    assert [r["seq"] for r in io.read_sequences(spark, str(tmp_path / "q")).orderBy("qid").collect()] == ["ACGT", "TTT", "GG"]
    (tmp_path / "f.fa").write_text(">one x\nACG\nTT\n>two\nGG\n")
    assert [r["seq"] for r in io.read_sequences(spark, str(tmp_path / "f.fa"), "fasta").orderBy("qid").collect()] == ["ACGTT", "GG"]
    (tmp_path / "g.fa").write_text(">s1 A->C variant\nACG\r\nTT\n>s2 > x\nGG\n>s3\n>s4\nCC\n")
    assert [r["seq"] for r in io.read_sequences(spark, str(tmp_path / "g.fa"), "fasta").orderBy("qid").collect()] == ["ACGTT", "GG", "", "CC"]
    with pytest.raises(ValueError):
        io.read_sequences(spark, "x", "other")


def test_trailers(spark, tmp_path):
    for name, version in (("a.dat", 2), ("b.dat", 1)):
        (tmp_path / name).write_bytes(b"x" * 50 + struct.pack("<QQQQI", 21, 3, 1, 0x0102030405060708, version))
    (tmp_path / "short").write_bytes(b"x")
    got = {r["path"].rsplit("/", 1)[1]: r for r in io.read_trailers(spark, str(tmp_path)).collect()}
    assert set(got) == {"a.dat", "b.dat"}
    assert (int(got["a.dat"]["kmer_size"]), int(got["a.dat"]["cutoff"]), got["a.dat"]["version"], got["a.dat"]["valid"]) == (21, 3, 2, True)
    assert not got["b.dat"]["valid"]
    assert io.compatible(io.read_trailers(spark, str(tmp_path / "a.dat"))) and not io.compatible(io.read_trailers(spark, str(tmp_path)))


@pytest.fixture(scope="module")
def index(spark):
    return X.index_reads(spark.createDataFrame(brute.sample_reads(), "sample string, seq string"), 5)


def test_save_and_load(spark, index, tmp_path):
    tree = mst.encode(index)
    io.save_index(index, str(tmp_path / "all"), tree)
    io.save_index(index, str(tmp_path / "tree"), tree, keep_classes=False)
    for name in ("all", "tree"):
        back, _ = io.load_index(spark, str(tmp_path / name))
        assert back.k == 5
        for t in ("dbg", "color_classes", "experiments"):
            assert sorted(map(str, getattr(back, t).collect())) == sorted(map(str, getattr(index, t).collect()))
    with pytest.raises(ValueError):
        io.save_index(index, str(tmp_path / "no"), None, keep_classes=False)


def test_results(spark, index, tmp_path):
    qs = spark.createDataFrame([(0, brute.sample_reads()[0][1]), (1, "AC")], "qid long, seq string")
    res, head = query.named(query.query(index, qs), index.experiments), query.num_kmers(qs, 5)
    want = {r["sample"]: r["n"] for r in res.where("qid = 0").collect()}
    text = {r["qid"]: r["value"] for r in io.result_text(res, head, "seq").collect()}
    lines = text[0].split("\n")
    assert lines[0].startswith("seq0\t") and dict(x.split("\t") for x in lines[1:]) == {s: str(n) for s, n in want.items()}
    assert text[1] == "seq1\t0"
    objects = [json.loads(r["value"]) for r in io.result_json(res, head).orderBy("qid").collect()]
    assert objects[0]["res"] == want and objects[1] == {"qnum": 1, "num_kmers": 0, "res": {}}
    io.write_blocks(io.result_text(res, head), str(tmp_path / "out"))
    assert spark.read.text(str(tmp_path / "out")).count() == len(lines) + 1


def test_stream(spark, index, tmp_path):
    rows = [(i, s) for i, (_, s) in enumerate(brute.sample_reads()[:4])]
    qs = spark.createDataFrame(rows, "qid long, seq string")
    qs.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("qid long, seq string").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    query_stream(index, stream, str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination(120)
    got = spark.read.parquet(str(tmp_path / "out")).select("qid", "sample", F.col("n"))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, query.named(query.query(index, qs), index.experiments).collect()))
