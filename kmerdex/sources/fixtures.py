"""Sequences from text tables: a fixed projection of letters to bases, the same in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

LETTERS = "abcdefghijklmnopqrstuvwxyz\n"
#: Letters in turn become A, C, G, T; a new line becomes N, which breaks a sequence; all else vanishes.
TO = ("ACGT" * 7)[:26] + "N"

SQL = "translate(regexp_replace(lower({}), '[^a-z\\n]', '', 'g'), 'abcdefghijklmnopqrstuvwxyz' || chr(10), '" + TO + "')"


def bases(text: Column) -> Column:
    return F.translate(F.regexp_replace(F.lower(text), "[^a-z\n]", ""), LETTERS, TO)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """Rows dealt out anew where the input has fewer splits than there are cores, as a small table of one file has."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(sample, seq) of documents; a source is a sample."""
    return spread(table(spark, sf_dir, "documents").select(F.col("source").alias("sample"), "text")).select("sample", bases(F.col("text")).alias("seq"))


def talks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(sample, seq) of conversations; the number of the turn is the sample."""
    return table(spark, sf_dir, "conversations").select(F.col("turn").cast("string").alias("sample"), bases(F.col("text")).alias("seq"))


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(qid, seq) of benchmark."""
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("qid"), bases(F.col("text")).alias("seq"))
