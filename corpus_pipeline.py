"""The corpus pipeline: each stage works on the documents that the one before kept.

All stages but the last return the columns of their documents, whatever their names and order; null texts count as empty ones, texts
are read whole, and an empty table gives an empty one. What each does with null ids and repeated rows is said there.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kmerdex.llm import bpe, decontaminate, quality, shared, simhash, substring_dedup


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier takes for good (score 0.5 or more); rows are judged one by one, and without labels all stay."""
    shared.tune(spark)
    weights = quality.train(docs, shared.read(spark, sf_dir, "labels"), "quality", quality.remainder(3) != 1)
    return quality.score(docs, weights, out="score_").where("score_ >= 0.5").drop("score_")


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-copies: texts that SimHash links (or MinHash bands, beyond its radius) are compared by five-word shingles, similarity 0.8 or more. Rows with a null id stay; of rows repeated under one id all stay or none."""
    return simhash.distinct(docs)


def substring_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 50 words that an earlier document has are cut out; a document without any keeps its text as it is. Repeated rows of an id cut nothing from each other, rows with a null id neither lose nor take."""
    cut = substring_dedup.remove_repeats(docs)
    text = F.when(F.col("n_removed_") > 0, F.col("kept_")).otherwise(F.col("text"))
    return cut.select(*[text.alias(c) if c == "text" else F.char_length(text).cast("long").alias(c) if c == "n_chars" else c for c in docs.columns])


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no window of a benchmark item; rows with a null id are judged like others, equal rows alike."""
    return decontaminate.clean(docs, shared.read(spark, sf_dir, "benchmark"))


def encoding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each row, and the text that they decode to."""
    coded = bpe.decode(bpe.encode(docs))
    return coded.select("doc_id", "lang", "source", "ids", F.size("ids").cast("long").alias("n_tokens"), F.col("decoded").cast("string").alias("text"))


STAGES = [
    ("quality", quality_stage),
    ("near_dedup", near_dedup_stage),
    ("substring_dedup", substring_stage),
    ("decontamination", decontamination_stage),
    ("encoding", encoding_stage),
]

#: Neither the classifier nor the encoding can be expressed in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over documents, each one's result written and read again."""
    docs = shared.read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = shared.written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
