import json

import pytest

from kmerdex.__main__ import main
from kmerdex.operators import index as X
from kmerdex.operators.query import named, query
from kmerdex.sources import io

from . import brute


def test_verbs(spark, tmp_path, capsys):
    rows = brute.sample_reads(samples=3)
    paths = []
    for s in ("s0", "s1", "s2"):
        paths.append(tmp_path / f"{s}.txt")
        paths[-1].write_text("\n".join(q for x, q in rows if x == s))
    (tmp_path / "list").write_text("\n".join(map(str, paths)))
    (tmp_path / "q").write_text(rows[1][1] + " ACG\n" + rows[7][1])
    d, ls, q = (str(tmp_path / x) for x in ("index", "list", "q"))
    assert main(["build", "-i", ls, "-o", d, "-k", "5", "-e"], spark) == 0
    assert main(["validate", "-i", ls, "-p", d, q], spark) == 0
    index = X.index_reads(spark.createDataFrame([(str(paths[int(s[1])]), x) for s, x in rows], "sample string, seq string"), 5)
    qs = spark.createDataFrame(list(enumerate([rows[1][1], "ACG", rows[7][1]])), "qid long, seq string")
    want = {(r["qid"], r["sample"]): r["n"] for r in named(query(index, qs), index.experiments).collect()}
    for verb in (["mst", "-p", d, "-k"], ["mst", "-p", d, "-d"]):
        assert main(verb, spark) == 0 and main(["validatemst", "-p", d], spark) == 0
        assert main(["query", "-p", d, "-j", "-o", f"{d}-out", q], spark) == 0
        got = [json.loads(r["value"]) for r in spark.read.text(f"{d}-out").collect()]
        assert {(o["qnum"], s): n for o in got for s, n in o["res"].items()} == want and len(got) == 3
    assert main(["query", "-p", d, "-1", "-k", "6", "-o", f"{d}-text", q], spark) == 0
    assert spark.read.text(f"{d}-text").where("value like '1\t%'").count() == 1
    for kind in ("mono", "cc_density", "color_dist", "jmerkmer"):
        assert main(["stats", "-p", d, "-t", kind, "-j", "4", "-o", f"{d}-{kind}"], spark) == 0
    with pytest.raises(SystemExit):
        main(["mst", "-p", d], spark)


def test_samples_by_whole_path_and_cutoff(spark, tmp_path, capsys):
    (tmp_path / "a").mkdir()
    (tmp_path / "x.txt").write_text("AAACCCGG\nAAACCCGG\nGGTTAC")
    (tmp_path / "a" / "x.txt").write_text("ACGTACGATT\nACGTACGATT")
    (tmp_path / "list").write_text(f"{tmp_path}/x.txt\n{tmp_path}/a/x.txt\n")
    (tmp_path / "q").write_text("AAACCCGG\nACGTACGATT\nGGTTAC\n")
    d, ls, q = (str(tmp_path / x) for x in ("index", "list", "q"))
    assert main(["build", "-i", ls, "-o", d, "-k", "5", "-c", "2"], spark) == 0
    assert main(["validate", "-i", ls, "-p", d, q], spark) == 0
    meta = io.read_meta(spark, d)
    assert meta["cutoff"] == 2 and meta["inputs"] == ls and meta["started"] < meta["ended"] and meta["k"] == 5
    assert main(["query", "-p", d, "-1", "-j", "-o", f"{d}-out", q], spark) == 0
    got = [json.loads(r["value"])["res"] for r in spark.read.text(f"{d}-out").collect()]
    assert [set(g) for g in got] == [{f"{tmp_path}/x.txt"}, {f"{tmp_path}/a/x.txt"}, set()]
    assert main(["mst", "-p", d, "-d"], spark) == 0 and spark.read.parquet(f"{d}/color_classes").count() == 0
    assert main(["mst", "-p", d, "-k"], spark) == 0 and main(["validatemst", "-p", d], spark) == 0
    assert spark.read.parquet(f"{d}/color_classes").count() == 2
    assert main(["query", "-p", d, "-k", "6", "-o", f"{d}-text", q], spark) == 0
    assert [r["value"] for r in spark.read.text(f"{d}-text").where("value like 'seq%'").collect()] == ["seq0\t8", "seq1\t10", "seq2\t6"]
