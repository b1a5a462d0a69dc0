"""Statistics of the graph and its colors."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.kmers import BASES, canonical, kmers
from .index import Index
from .mst import adjacency
from .tables import components, stored


def color_distribution(index: Index) -> DataFrame:
    """(color_id, count): k-mers of each color."""
    return index.dbg.groupBy("color_id").agg(F.count("*").alias("count"))


def class_density(index: Index) -> DataFrame:
    """(sample_id, place, count): over k-mers, how often a sample is the place-th (from 1) of its color's samples."""
    per = color_distribution(index).join(index.color_classes.select("color_id", "samples"), "color_id")
    return per.select("count", F.posexplode("samples").alias("pos", "sample_id")).groupBy("sample_id", (F.col("pos") + 1).alias("place")).agg(F.sum("count").alias("count"))


def monochromatic(index: Index) -> DataFrame:
    """(kmer, color_id, component): components of k-mers of one color; the component is its smallest k-mer."""
    same = adjacency(index.dbg).where("color_id = neighbor_color and kmer < neighbor")
    of = components(stored(same.select(F.col("kmer").alias("a"), F.col("neighbor").alias("b")), "same-color"))
    return index.dbg.join(of, F.col("kmer") == F.col("node"), "left").select("kmer", "color_id", F.coalesce("component", "kmer").alias("component"))


def component_sizes(mono: DataFrame) -> DataFrame:
    """(size, components, colors): components of each size, and per color how many, as text color:number."""
    each = mono.groupBy("component").agg(F.count("*").alias("size"), F.min("color_id").alias("color_id"))
    by = each.groupBy("size", "color_id").agg(F.count("*").alias("n"))
    pair = F.sort_array(F.collect_list(F.struct("color_id", "n")))
    text = F.array_join(F.transform(pair, lambda p: F.concat_ws(":", p["color_id"].cast("string"), p["n"].cast("string"))), ",")
    return by.groupBy("size").agg(F.sum("n").alias("components"), text.alias("colors"))


def confused(index: Index, j: int) -> DataFrame:
    """(kmer, confused): whether some j-mer of the k-mer has a sibling among the j-mers of all k-mers.

    Siblings differ in their first base or in their last one only. The answer does not depend on any order.
    """
    if not 1 < j <= index.k:
        raise ValueError("j must be from 2 to k")
    parts = stored(kmers(index.dbg.select("kmer").withColumnRenamed("kmer", "word"), "word", j, "word").select("word", F.col("kmer").alias("jmer")).distinct(), "jmers")
    known = parts.select("jmer").distinct()
    x = F.col("jmer")
    others = [canonical(F.concat(F.substring(x, 1, F.length(x) - 1), F.lit(b))) for b in BASES] + [canonical(F.concat(F.lit(b), F.substring(x, 2, F.length(x)))) for b in BASES]
    near = known.select("jmer", F.explode(F.array_distinct(F.array(*others))).alias("other")).where("jmer <> other")
    bad = near.join(known.select(F.col("jmer").alias("other")), "other", "left_semi").select("jmer").distinct()
    words = parts.join(bad, "jmer", "left_semi").select("word").distinct().withColumn("confused", F.lit(True))
    return index.dbg.select("kmer").join(words, F.col("kmer") == F.col("word"), "left").select("kmer", F.coalesce("confused", F.lit(False)).alias("confused"))


def stats(index: Index, kind: str = "mono", j: int = 23) -> DataFrame:
    """By kind: mono, color_dist, cc_density or jmerkmer."""
    if kind == "mono":
        return component_sizes(monochromatic(index))
    if kind == "color_dist":
        return color_distribution(index)
    if kind == "cc_density":
        return class_density(index)
    if kind == "jmerkmer":
        return confused(index, j)
    raise ValueError(f"unknown kind {kind}")
