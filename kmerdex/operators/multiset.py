"""k-mer multisets, as rows (kmer, count) with a count above zero."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def insert(counts: DataFrame, rows: DataFrame) -> DataFrame:
    """Counts added; rows of count zero add nothing."""
    return merge(counts, rows)


def merge(*multisets: DataFrame) -> DataFrame:
    """Counts of equal k-mers added, over any number of multisets and in one shuffle."""
    all_ = reduce(DataFrame.unionByName, [m.select("kmer", "count") for m in multisets])
    return all_.where("count > 0").groupBy("kmer").agg(F.sum("count").alias("count"))


def intersect(kept: DataFrame, other: DataFrame) -> DataFrame:
    """Rows of kept whose k-mer other has, with the counts of kept (by convention the larger multiset)."""
    return kept.join(other.select("kmer"), "kmer", "left_semi").select("kmer", "count")


def inner_product(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row: the sum of products of counts over common k-mers."""
    both = a.select("kmer", F.col("count").alias("x")).join(b.select("kmer", F.col("count").alias("y")), "kmer")
    return both.agg(F.coalesce(F.sum(F.col("x") * F.col("y")), F.lit(0)).alias("inner_product"))


def magnitude(a: DataFrame) -> DataFrame:
    """One row: the whole part of the root of the product of a multiset with itself."""
    return a.agg(F.floor(F.sqrt(F.coalesce(F.sum(F.col("count") * F.col("count")), F.lit(0)))).alias("magnitude"))


def lookup(counts: DataFrame, keys: DataFrame) -> DataFrame:
    """(kmer, count) for each of keys; zero for k-mers that aren't there."""
    return keys.select("kmer").join(counts, "kmer", "left").select("kmer", F.coalesce("count", F.lit(0)).cast("long").alias("count"))


def set_count(counts: DataFrame, new: DataFrame) -> DataFrame:
    """Counts replaced or added; a new count of zero changes nothing."""
    n = new.where("count > 0").select("kmer", F.col("count").alias("new"))
    return counts.join(n, "kmer", "full").select("kmer", F.coalesce("new", "count").alias("count"))


def remove(counts: DataFrame, gone: DataFrame) -> DataFrame:
    """Counts subtracted; k-mers that reach zero or less go."""
    n = gone.groupBy("kmer").agg(F.sum("count").alias("gone"))
    return counts.join(n, "kmer", "left").select("kmer", (F.col("count") - F.coalesce("gone", F.lit(0))).alias("count")).where("count > 0")


def delete(counts: DataFrame, keys: DataFrame) -> DataFrame:
    """Without the k-mers of keys."""
    return counts.join(keys.select("kmer"), "kmer", "left_anti").select("kmer", "count")


def key_range(counts: DataFrame, low: str, high: str) -> DataFrame:
    """k-mers from low to before high in string order; the filter reaches the scan."""
    return counts.where((F.col("kmer") >= low) & (F.col("kmer") < high))


def totals(counts: DataFrame) -> DataFrame:
    """One row: n_distinct, n_total, largest."""
    return counts.agg(F.count("*").alias("n_distinct"), F.coalesce(F.sum("count"), F.lit(0)).alias("n_total"), F.coalesce(F.max("count"), F.lit(0)).alias("largest"))
