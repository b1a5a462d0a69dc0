"""Queries: distinct k-mers of each query sequence in each sample."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.kmers import kmers
from .index import Index


def query_kmers(queries: DataFrame, k: int) -> DataFrame:
    """Distinct (qid, kmer) of queries (qid, seq)."""
    return kmers(queries, "seq", k, "qid").select("qid", "kmer").distinct()


def num_kmers(queries: DataFrame, k: int) -> DataFrame:
    """(qid, num_kmers) for every query, 0 included."""
    found = query_kmers(queries, k).groupBy("qid").agg(F.count("*").alias("num_kmers"))
    return queries.select("qid").join(found, "qid", "left").select("qid", F.coalesce("num_kmers", F.lit(0)).cast("long").alias("num_kmers"))


def total_kmers(queries: DataFrame, k: int) -> DataFrame:
    """One row: total, the numbers of distinct k-mers of all queries added up."""
    return num_kmers(queries, k).agg(F.coalesce(F.sum("num_kmers"), F.lit(0)).alias("total"))


def touched(index: Index, queries: DataFrame) -> DataFrame:
    """The distinct color_ids of the queries' k-mers at the index's k, which are also those of all constituents of longer ones."""
    return query_kmers(queries, index.k).select("kmer").distinct().join(index.dbg, "kmer").select("color_id").distinct()


def query(index: Index, queries: DataFrame, k: int | None = None, classes: DataFrame | None = None) -> DataFrame:
    """(qid, sample_id, n): n > 0 distinct k-mers of the query are in the sample.

    With k larger than the index's, n counts k-mers all of whose constituents are in the sample. k-mers are counted per color before
    colors are expanded to samples. classes replaces the index's color classes, for example by decoded ones.
    """
    k = k or index.k
    if k < index.k:
        raise ValueError("k must not be less than the index's")
    classes = (index.color_classes if classes is None else classes).select("color_id", "samples")
    if k > index.k:
        return _larger(index, queries, k, classes)
    hits = query_kmers(queries, k).join(index.dbg, "kmer").groupBy("qid", "color_id").agg(F.count("*").alias("n"))
    return hits.join(classes, "color_id").select("qid", F.explode("samples").alias("sample_id"), "n").groupBy("qid", "sample_id").agg(F.sum("n").alias("n"))


def _larger(index: Index, queries: DataFrame, k: int, classes: DataFrame) -> DataFrame:
    big = query_kmers(queries, k).withColumnRenamed("kmer", "big")
    parts = kmers(big, "big", index.k, "qid", "big")
    # of each large k-mer, how many of its places have each color; then how many have each sample
    colors = parts.join(index.dbg, "kmer").groupBy("qid", "big", "color_id").agg(F.count("*").alias("n"))
    samples = colors.join(classes, "color_id").select("qid", "big", F.explode("samples").alias("sample_id"), "n")
    full = samples.groupBy("qid", "big", "sample_id").agg(F.sum("n").alias("n")).where(F.col("n") == k - index.k + 1)
    return full.groupBy("qid", "sample_id").agg(F.count("*").alias("n"))


def named(result: DataFrame, experiments: DataFrame) -> DataFrame:
    """(qid, sample, n); an unknown sample has an empty name."""
    return result.join(experiments, "sample_id", "left").select("qid", F.coalesce("sample", F.lit("")).alias("sample"), "n")


def ground_truth(sample_kmers: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """As query(), straight from (sample_id, kmer) rows; rows that no query asks for are left out before repeated ones are looked for."""
    asked = query_kmers(queries, k)
    held = sample_kmers.select("sample_id", "kmer").join(asked.select("kmer").distinct(), "kmer", "left_semi").distinct()
    return asked.join(held, "kmer").groupBy("qid", "sample_id").agg(F.count("*").alias("n"))
