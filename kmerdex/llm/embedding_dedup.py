"""Embedding near-duplicates by a subspace pigeonhole join.

Unit vectors with cosine c lie at squared distance 2 - 2c. After a fixed rotation the vectors are split into
blocks, and the squared distance is split over the blocks in proportion to their sizes: a pair within
the whole budget is within its share of it in one block at least. In each block vectors are laid on a grid
over the block's first coordinates; each goes to its own cell and to later cells that its share can reach,
and pairs are compared there, first within the block, then in full and in double precision. A pair
counts in the first block whose share it meets, so it counts once, and is never written: cells return
numbers of links and pairs that span the components. Equal vectors are joined before and counted together.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType

from . import shared

COSINE = 0.95
#: Numbers in a block, coordinates of its grid, numbers of the vectors that meet in one task on either side (8 MB of doubles).
BLOCK, GRID, TILE = 16, 3, 1 << 20
#: Cells whose counts are sent to every executor. There are at most blocks times the GRID-th power of a grid's width of them for each
#: size of vectors, however many vectors there are; beyond this number they are joined.
BROADCAST_CELLS = 500_000
#: Vectors of one side that are compared at a time inside a tile.
ROWS = 256
#: Slack for rounding, in squared distance; the last test is on the cosine itself.
SLACK = 1e-6


def rotation(size: int) -> np.ndarray:
    return np.linalg.qr(np.random.default_rng(size).standard_normal((size, size)))[0]


def unit(raw: np.ndarray) -> np.ndarray:
    """Rows of float numbers scaled to length one in double precision."""
    x = raw.astype(np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def blocks(size: int) -> list[slice]:
    count = max(1, size // BLOCK)
    edge = [size * i // count for i in range(count + 1)]
    return [slice(a, z) for a, z in zip(edge[:-1], edge[1:])]


def shares(size: int, cosine: float) -> list[float]:
    return [(2 - 2 * cosine) * (b.stop - b.start) / size + SLACK for b in blocks(size)]


def spread(ids: np.ndarray, raw: np.ndarray, cosine: float):
    """(index, block, cell, side): side 0, at home, and side 2, a probe, in a vector's own cell; side 1, a probe, in the later cells that its share reaches."""
    size = raw.shape[1]
    y = unit(raw) @ rotation(size)
    for k, (at, share) in enumerate(zip(blocks(size), shares(size, cosine))):
        reach = np.sqrt(share)
        width = 2 * reach
        dims = min(GRID, at.stop - at.start)
        x = y[:, at][:, :dims]
        side = int(np.ceil(1 / width)) + 1
        base = 2 * side + 1
        home = np.floor(x / width).astype(np.int64) + side
        place = base ** np.arange(dims)
        own = home @ place
        index = np.arange(len(ids))
        yield index, np.full(len(ids), k), own, np.zeros(len(ids), np.int64)
        low, high = x - (home - side) * width, (home - side + 1) * width - x
        for step in itertools.product((-1, 0, 1), repeat=dims):
            step = np.array(step)
            gap = np.where(step < 0, low, np.where(step > 0, high, 0.0))
            cell = (home + step) @ place
            ok = np.flatnonzero(((gap * gap).sum(axis=1) <= share) & (cell >= own))
            yield index[ok], np.full(len(ok), k), cell[ok], 1 + (cell[ok] == own[ok])


def compared(block: int, home: tuple, probe: tuple, cosine: float):
    """Links between home vectors and probes (ids, numbers, raw vectors, own-cell flags): (id, links) and spanning (a, b)."""
    (hi, hn, hv, _), (pi, pn, pv, same) = home, probe
    size = hv.shape[1]
    parts, limits = blocks(size), shares(size, cosine)
    turn = rotation(size)
    x, y = unit(hv), unit(pv)
    xr, yr = x @ turn, y @ turn
    at = parts[block]
    xb, yb = xr[:, at].astype(np.float32), yr[:, at].astype(np.float32)
    sx, sy = (xb * xb).sum(1), (yb * yb).sum(1)
    ids = np.unique(np.concatenate([hi, pi]))
    hu, pu = np.searchsorted(ids, hi), np.searchsorted(ids, pi)
    label, links = np.arange(len(ids)), np.zeros(len(ids), np.int64)
    # pairs of a few rows at a time are counted and forgotten, so memory does not grow with the links of a tile
    for lo in range(0, len(hi), ROWS):
        near = xb[lo : lo + ROWS] @ yb.T
        near *= -2
        near += sx[lo : lo + ROWS, None]
        near += sy
        i, j = np.nonzero(near <= limits[block] + 1e-5)
        i += lo
        ok = (hi[i] != pi[j]) & (~same[j] | (hi[i] < pi[j]))
        i, j = i[ok], j[ok]
        for at_ in range(0, len(i), 1 << 16):
            p, q = i[at_ : at_ + (1 << 16)], j[at_ : at_ + (1 << 16)]
            d = xr[p] - yr[q]
            d *= d
            ok = d[:, at].sum(1) <= limits[block]
            for k in range(block):
                ok &= d[:, parts[k]].sum(1) > limits[k]
            ok &= (x[p] * y[q]).sum(1) >= cosine
            p, q = p[ok], q[ok]
            np.add.at(links, hu[p], pn[q])
            np.add.at(links, pu[q], hn[p])
            u, v = label[hu[p]], label[pu[q]]
            apart = u != v
            if apart.any():
                label = shared.forest(len(ids), u[apart], v[apart])[label]
    found = np.flatnonzero(links)
    return ids[found], links[found], ids[label[found]]


def near_duplicates(vectors: DataFrame, cosine: float = COSINE, vec_id: str = "vec_id", vector: str = "embedding", tile: int | None = None) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row of vectors.

    Vectors that are null, empty or zero, or hold a null or a number that isn't finite, link with nothing.
    Vectors of different sizes do not link. Ids are long numbers; a row with a null id links with nothing, has a null component and is not kept. Repeated rows stay and count as vectors of their own,
    so that a vector and its copy link. Other columns are ignored. An empty table gives an empty one. tile is the number of vectors
    that meet in one task on either side (by default what makes TILE numbers); vectors of floats travel as floats.
    """
    spark = vectors.sparkSession
    shared.tune(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "4096")
    kind = "float" if vectors.schema[vector].dataType == ArrayType(FloatType(), vectors.schema[vector].dataType.containsNull) else "double"
    dtype = np.dtype("f4" if kind == "float" else "f8")
    v = F.col("v")
    fine = F.coalesce(F.size(v) > 0, F.lit(False)) & ~F.exists(v, lambda e: e.isNull() | F.isnan(e) | (F.abs(e) == float("inf"))) & F.exists(v, lambda e: e != 0)
    rows = vectors.select(F.col(vec_id).cast("long").alias("id"), F.col(vector).cast(f"array<{kind}>").alias("v"))
    rows = rows.select("id", F.when(F.coalesce(fine, F.lit(False)) & F.col("id").isNotNull(), v).alias("v"))
    own = rows.where("v is not null").groupBy("v").agg(F.min("id").alias("rep"), F.count("*").alias("n"))
    own = shared.written(own.select("rep", "n", "v"), "vectors")

    def placed(batches, whole: bool):
        for b in batches:
            ids, lists = b.column(0).to_numpy(zero_copy_only=False), b.column(2)
            sizes = pa.compute.list_value_length(lists).to_numpy(zero_copy_only=False)
            for size in np.unique(sizes):
                at = np.flatnonzero(sizes == size)
                raw = lists.take(pa.array(at)).flatten().to_numpy(zero_copy_only=False).reshape(-1, size)
                n = b.column(1).take(pa.array(at))
                packed = pa.array([r.tobytes() for r in raw], pa.binary()) if whole else None
                for index, block, cell, side in spread(ids[at], raw, cosine):
                    key = [pa.array(np.full(len(index), size, np.int64)), pa.array(block), pa.array(cell), pa.array(side)]
                    take = pa.array(index)
                    rest = [pa.array(ids[at][index]), n.take(take), packed.take(take)] if whole else []
                    yield pa.RecordBatch.from_arrays(key + rest, ["size", "block", "cell", "side", "rep", "n", "raw"][: 7 if whole else 4])

    # a cell's rows on either side are dealt into tiles by a hash of the id; every pair of tiles is a task's work.
    # Vectors are placed twice, once to count the cells and once to be sent, so that they are shuffled only once
    cells = own.mapInArrow(lambda b: placed(b, False), "size long, block long, cell long, side long").groupBy("size", "block", "cell")
    cells = cells.agg(F.count_if(F.col("side") == 0).alias("homes"), F.count_if(F.col("side") > 0).alias("probes")).where("homes > 0 and probes > 0")
    most = F.lit(tile) if tile else F.greatest(F.lit(64), F.floor(F.lit(TILE) / F.col("size")))
    cells = shared.written(cells.select("size", "block", "cell", F.ceil(F.col("homes") / most).alias("th"), F.ceil(F.col("probes") / most).alias("tp")), "cells")
    few = F.broadcast if cells.limit(BROADCAST_CELLS + 1).count() <= BROADCAST_CELLS else (lambda x: x)
    laid = own.mapInArrow(lambda b: placed(b, True), "size long, block long, cell long, side long, rep long, n long, raw binary")
    dealt = laid.join(few(cells), ["size", "block", "cell"])
    mine = F.when(F.col("side") == 0, F.col("th")).otherwise(F.col("tp"))
    other = F.when(F.col("side") == 0, F.col("tp")).otherwise(F.col("th"))
    dealt = dealt.withColumn("my", F.pmod(F.xxhash64("rep"), mine)).withColumn("at", F.explode(F.sequence(F.lit(0).cast("long"), other - 1)))
    dealt = dealt.withColumn("i", F.when(F.col("side") == 0, F.col("my")).otherwise(F.col("at"))).withColumn("j", F.when(F.col("side") == 0, F.col("at")).otherwise(F.col("my")))

    def tiles(key, table):
        size, block = (k.as_py() for k in key[:2])
        side = table.column("side").to_numpy()
        ids, n = table.column("rep").to_numpy(), table.column("n").to_numpy()
        raw = np.frombuffer(b"".join(table.column("raw").to_pylist()), dtype).reshape(-1, size)
        home = np.flatnonzero(side == 0)
        probe = np.flatnonzero(side > 0)
        if not len(home) or not len(probe):
            a, links, b = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        else:
            a, links, b = compared(block, (ids[home], n[home], raw[home], None), (ids[probe], n[probe], raw[probe], side[probe] == 2), cosine)
        return pa.table({"a": pa.array(a, pa.int64()), "links": pa.array(links, pa.int64()), "b": pa.array(b, pa.int64())})

    # without this the join's partitioning by cell would do for the groups, and all tiles of a cell would meet in one task
    dealt = dealt.select("size", "block", "cell", "i", "j", "side", "rep", "n", "raw").repartition("size", "block", "cell", "i", "j")
    found = dealt.groupBy("size", "block", "cell", "i", "j").applyInArrow(tiles, "a long, links long, b long")
    found = shared.written(found, "found")
    links = found.groupBy("a").agg(F.sum("links").alias("links"))
    comp = shared.components(found.select("a", "b"))
    rep = own.select("v", "rep", "n").join(links, F.col("rep") == F.col("a"), "left").join(comp, F.col("rep") == F.col("node"), "left")
    rep = rep.select("v", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    out = rows.join(rep, "v", "left").select(F.col("id").alias("vec_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))


def op5_embedding_dedup(spark, sf_dir: str) -> DataFrame:
    """Links and component of each vector; a null or zero vector, or one that isn't finite, is a component of its own."""
    return near_duplicates(shared.read(spark, sf_dir, "embeddings").select("vec_id", "embedding"))


SQL = r"""
WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
link AS (SELECT a.vec_id AS a, b.vec_id AS b FROM e a JOIN e b ON a.vec_id <> b.vec_id AND len(a.v) = len(b.v) AND list_cosine_similarity(a.v, b.v) >= 0.95),
n AS (SELECT a, count(*) AS n FROM link GROUP BY a),
reach AS (
  WITH RECURSIVE r(id, other) AS (SELECT a, b FROM link UNION SELECT r.id, link.b FROM r JOIN link ON r.other = link.a)
  SELECT id, min(other) AS least FROM r GROUP BY id)
SELECT t.vec_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_links, least(t.vec_id, coalesce(reach.least, t.vec_id)) AS component_id,
       t.vec_id = least(t.vec_id, coalesce(reach.least, t.vec_id)) AS kept
FROM embeddings t LEFT JOIN n ON n.a = t.vec_id LEFT JOIN reach ON reach.id = t.vec_id
"""
