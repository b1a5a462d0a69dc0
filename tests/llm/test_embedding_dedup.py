import numpy as np

from kmerdex.llm import embedding_dedup as E


def brute(rows, cosine):
    ok = {}
    for n, (i, v) in enumerate(rows):
        if v and all(x is not None and np.isfinite(x) for x in v) and any(v):
            x = np.array(v, float)
            ok[n] = x / np.linalg.norm(x)
    links = [set() for _ in rows]
    for a in ok:
        for b in ok:
            if a != b and len(ok[a]) == len(ok[b]) and ok[a] @ ok[b] >= cosine:
                links[a].add(b)
    comp = [rows[n][0] for n in range(len(rows))]
    changed = True
    while changed:
        changed = False
        for a, bs in enumerate(links):
            low = min([comp[a], *(comp[b] for b in bs)])
            if low < comp[a]:
                comp[a], changed = low, True
    return sorted((rows[n][0], len(links[n]), comp[n], comp[n] == rows[n][0]) for n in range(len(rows)))


def test_brute_force(spark):
    rnd = np.random.default_rng(1)
    rows = []
    for g in range(12):
        base = rnd.standard_normal(48)
        for _ in range(6):
            rows.append((len(rows), (base + rnd.standard_normal(48) * rnd.choice([0.05, 0.2, 0.3])).astype(np.float32).tolist()))
    rows += [(len(rows) + i, rnd.standard_normal(48).astype(np.float32).tolist()) for i in range(40)]
    n = len(rows)
    rows += [(n, rows[3][1]), (n + 1, [x * 2 for x in rows[3][1]]), (n + 2, None), (n + 3, []), (n + 4, [0.0] * 48), (n + 5, [float("nan")] + [1.0] * 47), (n + 6, [None] + [1.0] * 47), (n + 7, [float("inf")] + [1.0] * 47), (n + 8, [1.0, 2.0]), (n + 9, [1.0, 2.01]), (n + 10, [3e-30] * 48), (n + 11, [1e30] * 48)]
    df = spark.createDataFrame([(i, v, "x") for i, v in rows], "vec_id long, embedding array<float>, rep string")
    rows = [(r["vec_id"], r["embedding"]) for r in df.collect()]
    want = brute(rows, 0.95)
    assert any(r[1] > 2 for r in want)
    for tile in (4096, 7):
        got = E.near_duplicates(df, tile=tile)
        assert sorted(map(tuple, got.select("vec_id", "n_links", "component_id", "kept").collect())) == want


def test_repeated_rows_and_empty(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [0.0, 1.0])], "vec_id long, embedding array<float>")
    assert sorted(map(tuple, E.near_duplicates(df).collect())) == [(1, 1, 1, True), (1, 1, 1, True), (2, 0, 2, True)]
    assert E.near_duplicates(df.limit(0)).count() == 0


def test_null_ids_link_with_nothing(spark):
    v = [1.0, 2.0, 3.0, 4.0]
    df = spark.createDataFrame([(None, v), (None, v), (3, v), (2, v), (None, None), (5, [0.0] * 4)], "vec_id long, embedding array<float>")
    got = sorted(map(str, map(tuple, E.near_duplicates(df).collect())))
    assert got == sorted(map(str, [(None, 0, None, False)] * 3 + [(3, 1, 2, False), (2, 1, 2, True), (5, 0, 5, True)]))
    nulls = df.where("vec_id is null")
    assert E.near_duplicates(nulls).count() == 3
