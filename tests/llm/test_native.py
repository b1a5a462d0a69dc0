import random
import re

import pytest

from pyspark.sql import functions as F

from kmerdex.llm import decontaminate as D
from kmerdex.llm import license_scan as L

from . import data

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(t):
    return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", (t or "").translate(LOW))


def contaminated(text, items, n):
    w, hit, found = words(text), set(), set()
    for i, t in items:
        x = words(t)
        wins = {tuple(x[a : a + n]) for a in range(max(1, len(x) - n + 1))} if x else set()
        for win in wins:
            for a in range(len(w) - len(win) + 1):
                if tuple(w[a : a + len(win)]) == win:
                    hit.update(range(a, a + len(win)))
                    found.add(str(i) if i is not None else "")
    return len(w), len(hit), sorted(found)


def test_contamination(spark, monkeypatch):
    docs = data.documents(spark)
    t = data.texts()
    rnd = random.Random(4)
    items = [(i, " ".join(words(t[8 + i])[5 : 5 + n]).upper()) for i, n in enumerate((30, 10, 9, 3, 12, 25))] + [(90, None), (91, ""), (92, "!!"), (None, " ".join(words(t[9])[:11])), (7, "nowhere " * 12), (1, " ".join(words(t[12])[:15]))]
    rnd.shuffle(items)
    table = spark.createDataFrame([(i, x, "c") for i, x in items], "item_id long, text string, doc_id string")
    for most in (D.BROADCAST_WINDOWS, 0):
        monkeypatch.setattr(D, "BROADCAST_WINDOWS", most)
        got = D.contamination(docs, table).select("doc_id", "n_words", D.covered(F.col("spans")).alias("hit"), "items").collect()
        assert len(got) == docs.select("doc_id", "text").distinct().count()
        by_id = {i: x for i, x in enumerate(t)} | {None: t[8]}
        for r in got:
            assert (r["n_words"], r["hit"], r["items"]) == contaminated(by_id[r["doc_id"]], items, 10), r["doc_id"]
        copies = {(r["doc_id"], r["text_key"]): r["copies"] for r in D.contamination(docs, table).collect()}
        rows = docs.select("doc_id", F.xxhash64("text").alias("k")).groupBy("doc_id", "k").count().collect()
        assert copies == {(r["doc_id"], r["k"]): r["count"] for r in rows} and max(copies.values()) > 1
    left = D.clean(docs, table)
    dirty = {i for i, x in by_id.items() if contaminated(x, items, 10)[1]}
    assert dirty and {r["doc_id"] for r in left.collect()} == set(by_id) - dirty and left.columns == docs.columns
    assert D.clean(docs, table.limit(0)).count() == docs.count() and D.contamination(docs.limit(0), table).count() == 0


def test_one_row_for_each_document_row(spark, tmp_path):
    t = "one two three four five six seven eight nine ten eleven"
    rows = [(1, t), (1, t), (1, t), (2, "x " + t), (None, None), (None, None), (3, "")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    # one window that very many items have is looked up in a table that is not sent around
    items = [(str(i), t) for i in range(300)]
    spark.createDataFrame(items, "item_id string, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    got = D.op9_decontaminate(spark, str(tmp_path)).select("doc_id", "n_words", "n_hit", "n_items", "contaminated").collect()
    want = [(1, 11, 11, 300, True)] * 3 + [(2, 12, 11, 300, True), (3, 0, 0, 0, False)] + [(None, 0, 0, 0, False)] * 2
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))


def test_what_is_sent_around_is_bounded(spark, monkeypatch):
    w = spark.createDataFrame([(["a" * 100] * 10,)] * 5, "win array<string>")
    assert D.fitting(w) is F.broadcast and D.fitting(w.limit(0)) is F.broadcast
    monkeypatch.setattr(D, "BROADCAST_BYTES", 5000)
    assert D.fitting(w) is None
    monkeypatch.setattr(D, "BROADCAST_BYTES", 1 << 20)
    monkeypatch.setattr(D, "BROADCAST_WINDOWS", 4)
    assert D.fitting(w) is None


def found_licenses(text, templates, threshold):
    w = [x for x in re.split(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").lower()) if x]
    pairs = list(zip(w, w[1:]))
    for name, notice in templates.items():
        n = [x for x in re.split(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", notice.lower()) if x]
        tb = set(zip(n, n[1:]))
        best = None
        for i, p in enumerate(pairs):
            if p in tb:
                own = pairs[i : i + len(n) - 1]
                d = 2 * len(set(own) & tb) / (len(set(own)) + len(tb))
                if d >= threshold and (best is None or d > best[0]):
                    best = (d, i, len(own) + 1)
        if best:
            yield name, *best


def test_licenses(spark):
    rnd = random.Random(2)
    full = L.TEMPLATES["mit-text"]
    wrapped = "\n// ".join(full[i : i + 60] for i in range(0, len(full), 60))  # broken inside words, too
    lines, words = "\n * ".join(" ".join(full.split()[i : i + 9]) for i in range(0, len(full.split()), 9)), full.split()
    edited = " ".join(x if rnd.random() > 0.04 else "xyz" for x in words)
    half = " ".join(words[: len(words) // 2])
    t = [None, "", "MIT", "Released under the MIT License.", "x\nreleased under THE mit license\ny", "Released under the the MIT License", "All rights reserved. All rights reserved.", "All Rights Reserved",
         "Licensed under the Apache License, Version 2.0 and more", "a b\nLicensed under CC BY-NC 4.0\n" + "word " * 5000, "LICENSED under CC BY 4.0.", "Released under the MIT License.",
         "Copyright 2020 Acme. Released\n    under the MIT\nLicense. More", "Licensed under the\nApache License,\nVersion 2.0.", wrapped, "intro " * 300 + lines + " outro" * 300, edited, half,
         L.TEMPLATES["bsd-3-clause-text"].upper(), "a\n" + L.TEMPLATES["bsd-2-clause-text"] + "\nb", "the software " * 2000]
    docs = spark.createDataFrame([(i, x, "c") for i, x in enumerate(t)] + [(None, t[3], "c"), (3, t[3], "c")], "doc_id long, text string, template string")
    want = [(i, *hit) for i, x in [*enumerate(t), (None, t[3]), (3, t[3])] for hit in found_licenses(x, L.TEMPLATES, L.THRESHOLD)]
    got = list(map(tuple, L.scan(docs).collect()))
    assert sorted(map(str, got)) == sorted(map(str, want))
    assert {12, 15, 16, 18} <= {r[0] for r in got} and (15, "mit-text") in {r[:2] for r in got} and 17 not in {r[0] for r in got}
    assert L.scan(docs.limit(0)).count() == 0 and L.scan(docs, {}).count() == 0


@pytest.mark.parametrize("threshold", [0.5, 0.7, 0.9])
def test_anchors_lose_no_window(spark, threshold):
    rnd = random.Random(5)
    words = [f"w{i}" for i in range(12)]
    templates = {f"t{k}": " ".join(rnd.choice(words) for _ in range(k)) for k in (2, 3, 6, 15)}
    texts = []
    for _ in range(150):
        w = rnd.choice(list(templates.values())).split()
        w = [x if rnd.random() > 0.2 else rnd.choice(words) for x in w]
        texts.append(" ".join([rnd.choice(words) for _ in range(rnd.randint(0, 8))] + w + [rnd.choice(words) for _ in range(rnd.randint(0, 8))]))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = [(i, *hit) for i, x in enumerate(texts) for hit in found_licenses(x, templates, threshold)]
    assert want and sorted(map(str, map(tuple, L.scan(docs, templates, threshold).collect()))) == sorted(map(str, want))
