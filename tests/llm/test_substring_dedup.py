import random
import re
import tracemalloc

import pyarrow as pa
import pytest

from kmerdex.llm import substring_dedup as S

from . import data


def brute(docs, window):
    split = {i: re.findall(r"[^\x20\x09-\x0D]+", t or "") for i, t in docs.items()}
    first = {}
    for i in sorted(split):
        w = split[i]
        for a in range(len(w) - window + 1):
            first.setdefault(tuple(w[a : a + window]), i)
    out = {}
    for i, w in split.items():
        gone = set()
        for a in range(len(w) - window + 1):
            if first[tuple(w[a : a + window])] < i:
                gone.update(range(a, a + window))
        out[i] = (len(w), len(gone), " ".join(x for p, x in enumerate(w) if p not in gone))
    return out


@pytest.mark.parametrize("probes", [2, 256])
def test_brute_force(spark, probes):
    docs = data.documents(spark)
    by_id = {r["doc_id"]: r["text"] for r in docs.collect() if r["doc_id"] is not None}
    want = brute(by_id, 50)
    got = S.remove_repeats(docs, shard_words=200, probes=probes).collect()
    assert len(got) == docs.count()
    for r in got:
        if r["doc_id"] is None:
            assert r["n_removed_"] == 0
        else:
            assert (r["n_words_"], r["n_removed_"], r["kept_"]) == want[r["doc_id"]], r["doc_id"]
    assert any(x[1] for x in want.values())
    assert set(docs.columns) - {"kept_"} <= set(got[0].asDict())


def test_later_documents_share_what_the_first_one_lacks(spark):
    rnd = random.Random(0)
    w = data.vocabulary(rnd, 400)
    base = [rnd.choice(w) for _ in range(120)]
    edited = base[:60] + ["NEW"] + base[61:]
    docs = {0: base, 1: edited, 2: edited, 3: base[:40] + ["x"] + edited[30:], 4: base}
    df = spark.createDataFrame([(i, " ".join(t)) for i, t in docs.items()], "doc_id long, text string")
    want = brute({i: " ".join(t) for i, t in docs.items()}, 10)
    for gram in (4, 10):
        got = S.remove_repeats(df, window=10, gram=gram).collect()
        assert {r["doc_id"]: (r["n_words_"], r["n_removed_"], r["kept_"]) for r in got} == want


def test_automaton():
    rnd = random.Random(1)
    for _ in range(50):
        a = [rnd.choice("abc") for _ in range(rnd.randint(0, 40))]
        b = [rnd.choice("abcd") for _ in range(40)]
        have = {tuple(a[i : i + 4]) for i in range(len(a) - 3)}
        assert S.Automaton(a).ends(b, 4) == [i for i in range(3, len(b)) if tuple(b[i - 3 : i + 1]) in have]


def test_empty(spark):
    assert S.remove_repeats(data.documents(spark).limit(0)).count() == 0


def test_memory_of_a_batch_of_long_copies(monkeypatch):
    """300 copies of a passage of 4,000 words, 9 MB: their words and hashes are not held all at once."""
    monkeypatch.setattr(S.shared, "_POWERS", {})
    w = data.vocabulary(random.Random(2), 3000)
    text = " ".join(w[i % len(w)] + "x" * (i // len(w)) for i in range(4000)).encode()
    edited = text.split()
    edited[2000] = b"NEW"
    bodies = [text] + [text] * 299 + [b" ".join(edited)]
    n = len(bodies)
    columns = {"owner": [0] * n, "salt": [0] * n, "probe": [False] + [True] * (n - 1), "id": range(n), "th": [None] + [7] * (n - 1), "start": [None] + [5] * (n - 1), "body": bodies}
    batch = pa.record_batch([pa.array(columns[c], t) for c, t in (("owner", pa.int64()), ("salt", pa.int32()), ("probe", pa.bool_()), ("id", pa.int64()), ("th", pa.int64()), ("start", pa.int32()), ("body", pa.binary()))], names=list(columns))
    tracemalloc.start()
    got = [r for b in S._matched([batch], 50, 30, 1, 200_000) for r in b.to_pylist()]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert [(r["id"], r["th"]) for r in got] == [(i, 7) for i in range(1, n)]
    assert all(r["spans"] == [{"s": 5, "e": 4005}] and not r["missed"] for r in got[:-1])
    assert got[-1]["spans"] == [{"s": 5, "e": 2005}, {"s": 2006, "e": 4005}] and len(got[-1]["missed"]) == 50
    assert peak < 100e6, peak


def test_passages_of_long_documents_are_cut():
    w = data.vocabulary(random.Random(3), 3000)
    words = [w[i % len(w)] + "x" * (i // len(w)) for i in range(40_000)]
    text = pa.array([" ".join(words)])
    keys = sorted(set(S.windows(S.shared.Words(text), 50, 30, 0)[1].tolist()))
    row = [pa.array([9]), pa.array([7]), text, pa.array([keys]), pa.array([[3] * len(keys)])]
    got = [r for b in S._passages([pa.RecordBatch.from_arrays(row, ["id", "th", "text", "keys", "owners"])], 50, 30, 0) for r in b.to_pylist()]
    bodies = [r["body"].decode().split() for r in got]
    assert all(len(x) < 20_000 and x == words[r["start"] : r["start"] + len(x)] for x, r in zip(bodies, got))
    assert sorted(r["start"] + i for x, r in zip(bodies, got) for i in range(len(x) - 49)) == list(range(40_000 - 49))
    assert {(r["owner"], r["id"], r["th"]) for r in got} == {(3, 9, 7)}


def test_brute_force_with_cut_passages(spark):
    docs = data.documents(spark)
    want = brute({r["doc_id"]: r["text"] for r in docs.collect() if r["doc_id"] is not None}, 50)
    for r in S.remove_repeats(docs, shard_words=200, probes=2, piece=7).collect():
        assert r["doc_id"] is None or (r["n_words_"], r["n_removed_"], r["kept_"]) == want[r["doc_id"]], r["doc_id"]
