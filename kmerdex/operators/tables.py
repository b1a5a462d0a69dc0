"""Tables written between steps, and ids for rows in a given order."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


_own: list[str] = []


def folder(spark: SparkSession) -> str:
    """The folder that the session names in spark.checkpoint.dir. Where it names none: one that ends with the process if all runs in it, else one in the warehouse."""
    top = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if top:
        return top.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        return spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_stored"
    if not _own:
        _own.append(tempfile.mkdtemp(prefix="kmerdex-"))
        atexit.register(shutil.rmtree, _own[0], ignore_errors=True)
    return _own[0]


def stored(df: DataFrame, name: str = "table") -> DataFrame:
    """df written to the folder that all executors share (spark.checkpoint.dir, else below the warehouse) and read back; lineage ends there."""
    spark = df.sparkSession
    path = f"{folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def numbered(df: DataFrame, name: str, *order: Column) -> DataFrame:
    """df with a long column of 0, 1, 2 ... in the given order, without one task that sees all rows.

    Rows are range-partitioned and sorted, numbered in each partition, and shifted by the sizes of the partitions before.
    """
    cols = df.columns
    parts = df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id())
    parts = stored(parts, "ranges")  # the ranges are drawn anew each time they are computed
    sizes = parts.groupBy("_part").count()
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    shift = sizes.select("_part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_shift"))  # a row for each partition
    inner = F.row_number().over(Window.partitionBy("_part").orderBy(*order))
    return parts.withColumn("_row", inner).join(F.broadcast(shift), "_part").select(*cols, (F.col("_row") - 1 + F.col("_shift")).cast("long").alias(name))


def components(edges: DataFrame) -> DataFrame:
    """(node, component) with the smallest node of each component, for edges (a, b); alternating large and small stars."""
    e = stored(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    last = None
    while True:
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        e2 = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = e2.groupBy("u").agg(F.min("v").alias("m"))
        e2 = e2.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v")))
        e = stored(e2.where("u <> v").distinct(), "edges")
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == last:
            return e.select(F.col("u").alias("node"), F.col("v").alias("component")).union(e.select("v", "v").distinct())
        last = now
