"""The color graph, its minimum spanning tree, and color classes encoded as differences along the tree.

The empty set is the root of the tree and has the color id ROOT. Trees are built on the driver while the
edges are few (a stated bound) and by Boruvka rounds over tables beyond it; both order edges by
(weight, u, v), so they find the same tree.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructType

from ..functions.kmers import neighbors
from .index import Index
from .tables import components, numbered, stored

ROOT = -1
#: Edges that the driver takes.
DRIVER_EDGES = 2_000_000


def adjacency(dbg: DataFrame) -> DataFrame:
    """(kmer, color_id, neighbor, neighbor_color) over edges of the graph, in both directions."""
    near = neighbors(dbg, "kmer", "color_id")
    return near.join(dbg.select(F.col("kmer").alias("neighbor"), F.col("color_id").alias("neighbor_color")), "neighbor")


def color_edges(index: Index) -> DataFrame:
    """Distinct (u, v), u < v, of colors that neighboring k-mers have."""
    a = adjacency(index.dbg)
    return a.where("color_id < neighbor_color").select(F.col("color_id").alias("u"), F.col("neighbor_color").alias("v")).distinct()


def difference(a: Column, b: Column) -> Column:
    """Sorted symmetric difference of two sets."""
    return F.array_sort(F.array_union(F.array_except(a, b), F.array_except(b, a)))


def weighted_edges(edges: DataFrame, classes: DataFrame) -> DataFrame:
    """(u, v, w): edges with the Hamming distance of their sets, and an edge to the root for every color."""
    c = classes.select("color_id", "samples")
    a = edges.join(c.select(F.col("color_id").alias("u"), F.col("samples").alias("su")), "u").join(c.select(F.col("color_id").alias("v"), F.col("samples").alias("sv")), "v")
    inner = a.select("u", "v", F.size(difference(F.col("su"), F.col("sv"))).alias("w"))
    return inner.union(c.select(F.lit(ROOT).cast("long").alias("u"), F.col("color_id").alias("v"), F.size("samples").alias("w")))


def spanning_tree(edges: DataFrame, driver_edges: int = DRIVER_EDGES) -> DataFrame:
    """The edges (u, v, w) of the minimum spanning forest."""
    if edges.limit(driver_edges + 1).count() <= driver_edges:
        return _table(edges, _kruskal(edges), "u long, v long, w int")
    return _boruvka(edges)


def rooted_tree(edges: DataFrame, driver_edges: int = DRIVER_EDGES) -> DataFrame:
    """(color_id, parent_id, weight) of every color in the minimum spanning tree; rooted where the tree is built."""
    if edges.limit(driver_edges + 1).count() > driver_edges:
        return rooted(_boruvka(edges))
    u, v, w = _kruskal(edges)
    a, b, w = np.r_[u, v], np.r_[v, u], np.r_[w, w]
    order = np.argsort(a, kind="stable")
    a, b, w = a[order], b[order], w[order]
    level, found = np.array([ROOT]), [np.zeros((3, 0), np.int64)]
    above = np.array([ROOT - 1])
    while len(level):
        lo, hi = np.searchsorted(a, level), np.searchsorted(a, level, side="right")
        n = hi - lo
        at = np.arange(n.sum()) + np.repeat(lo - np.cumsum(n) + n, n)
        parent, up = np.repeat(level, n), np.repeat(above, n)
        down = b[at] != up
        level, above = b[at][down], parent[down]
        found.append(np.stack([level, above, w[at][down]]))
    return _table(edges, np.concatenate(found, axis=1), "color_id long, parent_id long, weight int")


def _table(df: DataFrame, columns, fields: str) -> DataFrame:
    kind = StructType.fromDDL(fields)
    arrays = [pa.array(c, pa.int32() if f.dataType == IntegerType() else pa.int64()) for c, f in zip(columns, kind)]
    return df.sparkSession.createDataFrame(pa.table(arrays, names=kind.names), kind)


def _kruskal(edges: DataFrame) -> np.ndarray:
    """(u, v, w) of the forest's edges; the edges are three arrays on the driver, 24 bytes each."""
    t = edges.select("u", "v", F.col("w").cast("long").alias("w")).toArrow()
    u, v, w = (t.column(c).to_numpy() for c in ("u", "v", "w"))
    order = np.lexsort((v, u, w))
    nodes, place = np.unique(np.concatenate([u, v]), return_inverse=True)
    top = list(range(len(nodes)))
    kept = []
    for i, a, b in zip(order.tolist(), place[: len(u)][order].tolist(), place[len(u) :][order].tolist()):
        while top[a] != a:
            top[a] = top[top[a]]
            a = top[a]
        while top[b] != b:
            top[b] = top[top[b]]
            b = top[b]
        if a != b:
            top[a] = b
            kept.append(i)
    return np.stack([u[kept], v[kept], w[kept]])


def _boruvka(edges: DataFrame) -> DataFrame:
    edges = stored(edges, "weighted")
    of = stored(edges.select(F.col("u").alias("n")).union(edges.select("v")).distinct().select("n", F.col("n").alias("c")), "parts")
    tree = None
    while True:
        e = edges.join(of.select(F.col("n").alias("u"), F.col("c").alias("cu")), "u").join(of.select(F.col("n").alias("v"), F.col("c").alias("cv")), "v").where("cu <> cv")
        both = e.select("cu", "cv", "w", "u", "v").union(e.select("cv", "cu", "w", "u", "v"))
        best = both.groupBy("cu").agg(F.min(F.struct("w", "u", "v", "cv")).alias("b"))
        best = stored(best.select("cu", F.col("b.cv").alias("cv"), F.col("b.u").alias("u"), F.col("b.v").alias("v"), F.col("b.w").alias("w")), "best")
        if best.isEmpty():
            return tree if tree is not None else edges.limit(0).select("u", "v", "w")
        chosen = best.select("u", "v", "w").distinct()
        tree = chosen if tree is None else stored(tree.union(chosen), "tree")
        to = components(best.select(F.col("cu").alias("a"), F.col("cv").alias("b")))
        of = stored(of.join(to, F.col("c") == F.col("node"), "left").select("n", F.coalesce("component", "c").alias("c")), "parts")


def rooted(tree: DataFrame) -> DataFrame:
    """(color_id, parent_id, weight) of every color that hangs on the root.

    The tour around the tree passes each edge twice, first away from the root; an edge's two places in it tell the parent. After (u, v) it takes
    the arc that follows (v, u) among those of v, in a circle, and it ends before the root's first arc. Places are found by pointer
    jumping: rounds grow with the logarithm of the edges, however deep the tree is, and no arc has more than one before it, so no key is hot.
    """
    arcs = stored(numbered(tree.select("u", "v", "w").union(tree.select("v", "u", "w")), "arc", F.col("u"), F.col("v")), "arcs")
    back = arcs.select(F.col("v").alias("u"), F.col("u").alias("v"), F.col("arc").alias("back"))
    ends = arcs.groupBy("u").agg(F.min("arc").alias("first"), F.max("arc").alias("last")).withColumnRenamed("u", "v")
    arcs = arcs.join(back, ["u", "v"]).join(ends, "v")
    after = F.when(F.col("back") < F.col("last"), F.col("back") + 1).when(F.col("v") != ROOT, F.col("first"))
    arcs = stored(arcs.select("arc", "back", "u", "v", "w", after.alias("next")), "tour")
    at = stored(arcs.select("arc", "next", F.when(F.col("next").isNull(), 0).otherwise(1).cast("long").alias("left")), "places")
    n, steps = arcs.count(), 1
    while steps < n and not at.where("next IS NOT NULL").isEmpty():
        far = at.select(F.col("arc").alias("next"), F.col("next").alias("next2"), F.col("left").alias("more"))
        going = at.where("next IS NOT NULL").join(far, "next").select("arc", F.col("next2").alias("next"), (F.col("left") + F.col("more")).alias("left"))
        at = stored(at.where("next IS NULL").union(going), "places")
        steps *= 2
    at = at.where("next IS NULL")  # a circle apart from the root never ends
    down = arcs.drop("next").join(at.select("arc", "left"), "arc").join(at.select(F.col("arc").alias("back"), F.col("left").alias("less")), "back").where("left > less")
    return stored(down.select(F.col("v").alias("color_id"), F.col("u").alias("parent_id"), F.col("w").alias("weight")), "rooted")


def encode(index: Index, driver_edges: int = DRIVER_EDGES) -> DataFrame:
    """color_mst(color_id, parent_id, weight, delta): each class as its difference from its parent in the tree."""
    edges = weighted_edges(stored(color_edges(index), "color-edges"), index.color_classes)
    tree = rooted_tree(edges, driver_edges)
    c = index.color_classes
    a = tree.join(c.select("color_id", "samples"), "color_id").join(c.select(F.col("color_id").alias("parent_id"), F.col("samples").alias("up")), "parent_id", "left")
    return a.select("color_id", "parent_id", "weight", difference(F.col("samples"), F.coalesce("up", F.array().cast("array<int>"))).alias("delta"))


def ways(color_mst: DataFrame, colors: DataFrame) -> DataFrame:
    """The rows of color_mst on the ways from colors (color_id) to the root.

    Round i adds what lies 2^i steps above all that is found; rounds grow with the logarithm of the depth and move pairs of ids only.
    """
    found = stored(colors.select("color_id").distinct().join(color_mst.select("color_id"), "color_id", "left_semi"), "ways")
    above = stored(color_mst.where(F.col("parent_id") != ROOT).select("color_id", F.col("parent_id").alias("up")), "above")
    while not above.isEmpty():
        found = stored(found.union(found.join(above, "color_id").select("up")).distinct(), "ways")
        above = stored(above.join(above.select(F.col("color_id").alias("up"), F.col("up").alias("far")), "up").select("color_id", F.col("far").alias("up")), "above")
    return color_mst.join(found, "color_id", "left_semi")


def decode(color_mst: DataFrame, colors: DataFrame | None = None) -> DataFrame:
    """(color_id, samples) of all classes, or of colors (color_id) and what lies above them, by pointer jumping: the way to the root halves with each round."""
    if colors is not None:
        color_mst = ways(color_mst, colors)
    at = stored(color_mst.select("color_id", F.col("parent_id").alias("up"), F.col("delta").alias("samples")), "jump")
    while not at.where(F.col("up") != ROOT).isEmpty():
        far = at.select(F.col("color_id").alias("up"), F.col("up").alias("up2"), F.col("samples").alias("more"))
        done = at.where(F.col("up") == ROOT)
        going = at.where(F.col("up") != ROOT).join(far, "up")
        at = stored(done.union(going.select("color_id", F.col("up2").alias("up"), difference(F.col("samples"), F.col("more")).alias("samples"))), "jump")
    return at.select("color_id", "samples")
