"""Checks of an index; a valid one gives no rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import mst
from .index import Index
from .query import ground_truth, query


def validate(index: Index, sample_kmers: DataFrame, queries: DataFrame) -> DataFrame:
    """(qid, sample_id, expected, found) where the index's answer is not the one from the samples themselves."""
    a = ground_truth(sample_kmers, queries, index.k).select("qid", "sample_id", F.col("n").alias("expected"))
    b = query(index, queries).select("qid", "sample_id", F.col("n").alias("found"))
    return a.join(b, ["qid", "sample_id"], "full").where(~F.col("expected").eqNullSafe(F.col("found")))


def validate_mst(index: Index, color_mst: DataFrame) -> DataFrame:
    """(color_id, samples) that only the classes or only the decoded tree have."""
    a, b = index.color_classes.select("color_id", "samples"), mst.decode(color_mst).select("color_id", "samples")
    return a.exceptAll(b).unionByName(b.exceptAll(a))
