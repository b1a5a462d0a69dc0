import random

import corpus_pipeline as P

from kmerdex.llm import queries, shared

from . import data


def test_names():
    assert [n for n in range(1, 11) if not any(q.startswith(f"op{n}_") for q in queries.QUERIES)] == []
    assert set(queries.ORACLE) <= set(queries.QUERIES) and len(P.STAGES) == 5


def test_stages(spark, tmp_path):
    rnd = random.Random(1)
    w = data.vocabulary(rnd, 500)
    passage = [rnd.choice(w) for _ in range(60)]
    item = " ".join(rnd.choice(w) for _ in range(20))
    rows, labels = [], []
    for i in range(120):
        t = [rnd.choice(w) for _ in range(150)]
        if i in (5, 50, 90):
            t[40:40] = passage
        if i == 20:
            t[10:10] = item.split()
        bad = i % 6 == 3
        rows.append((i, " ".join(x.upper() + "!!" for x in t) if bad else " ".join(t), "en", "s", 1))
        labels.append((i, int(not bad), 0))
    near = rows[7][1].split()
    near[3] = "changed"
    rows += [(200, rows[2][1], "en", "s", 1), (201, " ".join(near), "en", "s", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    d = str(tmp_path)
    docs.write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    clean = {i for i in range(120) if i % 6 != 3}
    want = [clean | {200, 201}, clean, clean, clean - {20}, clean - {20}]
    now = docs
    for (name, stage), left in zip(P.STAGES, want):
        now = shared.written(stage(spark, now, d), name)
        got = {r["doc_id"]: r["text"] for r in now.collect()}
        assert set(got) == left and now.count() == len(left), name
        if name == "substring_dedup":
            text = {r[0]: r[1] for r in rows}
            assert all(" ".join(passage) not in got[i] for i in (50, 90)) and got[5] == text[5] and all(got[i] == text[i] for i in got if i not in (50, 90))
    assert sorted(map(str, P.run(spark, d).collect())) == sorted(map(str, now.collect()))
    empty = docs.limit(0)
    for _, stage in P.STAGES:
        assert stage(spark, empty, d).count() == 0


def test_stages_with_nulls_repeats_and_clashing_names(spark, tmp_path):
    docs = data.documents(spark)
    d = str(tmp_path)
    docs.write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame([(None, None), (1, ""), (None, "no such words here")], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    stages = dict(P.STAGES)
    now = shared.written(stages["quality"](spark, docs, d), "quality")
    assert now.columns == docs.columns and sorted(map(str, now.collect())) == sorted(map(str, docs.collect()))  # no labels: nothing is known against a text
    left = shared.written(stages["near_dedup"](spark, now, d), "near")
    rows = left.collect()
    assert left.columns == docs.columns and [r for r in rows if r["doc_id"] is None]
    by = {}
    for r in rows:
        if r["doc_id"] is not None:
            by.setdefault(r["text"] or "", set()).add(r["doc_id"])
    least = {}
    for r in docs.collect():
        if r["doc_id"] is not None:
            least[r["text"] or ""] = min(r["doc_id"], least.get(r["text"] or "", r["doc_id"]))
    assert all(ids == {least[t]} for t, ids in by.items()) and set(by) <= set(least)
    cut = shared.written(stages["substring_dedup"](spark, left, d), "cut")
    assert cut.columns == docs.columns and cut.count() == len(rows)
    clean = shared.written(stages["decontamination"](spark, cut, d), "clean")
    assert sorted(map(str, clean.collect())) == sorted(map(str, cut.collect()))
    coded = {(r["doc_id"], r["text"]) for r in stages["encoding"](spark, clean, d).collect()}
    assert coded == {(r["doc_id"], r["text"] or "") for r in clean.collect()}
