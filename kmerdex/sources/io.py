"""Readers and writers: manifests, sequences, sample trailers, indexes, results."""

from __future__ import annotations

import json
import re
from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import __version__
from ..operators.index import Index
from ..operators.tables import numbered, stored


def _tokens(spark: SparkSession, path: str) -> DataFrame:
    """(file, line, at, token) of white-space separated tokens; line numbers only order lines of a file."""
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("line"), F.split("value", r"\s+").alias("t"))
    return lines.select("file", "line", F.posexplode("t").alias("at", "token")).where("token <> ''")


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """(sample_id, path): one path for each token of a text file, numbered in its order."""
    t = numbered(_tokens(spark, path), "sample_id", F.col("file"), F.col("line"), F.col("at"))
    return t.select(F.col("sample_id").cast("int").alias("sample_id"), F.col("token").alias("path"))


def fasta_records(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(file, seq): the records of FASTA files. A record starts with a > at the start of a line; its header line, which may hold more of them, is dropped."""
    records = spark.read.option("lineSep", "\n>").text(path).where(F.trim("value") != "")
    return records.select(file_address(), F.regexp_replace(F.regexp_replace("value", r"^[^\n]*\n?", ""), r"\s", "").alias("seq"))


def files_of(spark: SparkSession, manifest: DataFrame) -> DataFrame:
    """(file, sample_id, sample): the files of each path of a manifest, by their full addresses. As many rows as the listed paths have files; a file may be of several samples."""
    rows = [(re.sub("^file:/+", "file:///", f), r["sample_id"], r["path"]) for r in manifest.collect() for f in spark.read.text(r["path"]).inputFiles()]
    return spark.createDataFrame(rows, "file string, sample_id int, sample string")


def file_address() -> Column:
    """The full address of the file that a row was read from, as files_of gives it."""
    return F.regexp_replace("_metadata.file_path", "^file:/+", "file:///").alias("file")


def read_sequences(spark: SparkSession, path: str, format: str = "tokens") -> DataFrame:
    """(qid, seq): every token is a sequence; with format fasta, every record is (headers start with >)."""
    if format == "tokens":
        return numbered(_tokens(spark, path), "qid", F.col("file"), F.col("line"), F.col("at")).select("qid", F.col("token").alias("seq"))
    if format == "fasta":
        records = fasta_records(spark, path).withColumn("at", F.monotonically_increasing_id())
        return numbered(records, "qid", F.col("file"), F.col("at")).select("qid", "seq")
    raise ValueError(f"unknown format {format}")


def _little(content: Column, at: Column, size: int) -> Column:
    """An unsigned little-endian number in bytes (at from 1)."""
    parts = [F.hex(F.substring(content, at + i, F.lit(1))) for i in reversed(range(size))]
    return F.conv(F.concat(*parts), 16, 10).cast("decimal(20,0)")


def read_trailers(spark: SparkSession, path: str) -> DataFrame:
    """(path, kmer_size, cutoff, contains_counts, endianness, version, valid) from the last 36 bytes of each sample file.

    Valid trailers are of version 2 and little-endian.
    """
    c = F.col("content")
    at = [F.length(c) - 35 + 8 * i for i in range(5)]
    f = spark.read.format("binaryFile").load(path).where(F.col("length") >= 36)
    out = f.select("path", *[_little(c, at[i], 8).alias(n) for i, n in enumerate(("kmer_size", "cutoff", "contains_counts", "endianness"))], _little(c, at[4], 4).cast("int").alias("version"))
    return out.withColumn("valid", (F.col("version") == 2) & (F.col("endianness") == F.lit(0x0102030405060708)))


def compatible(trailers: DataFrame) -> bool:
    """Whether all samples have one k-mer size and a valid trailer."""
    r = trailers.agg(F.count_distinct("kmer_size").alias("k"), F.coalesce(F.min("valid"), F.lit(False)).alias("v")).first()
    return bool(r["v"]) and r["k"] == 1


def _now() -> str:
    return datetime.now(timezone.utc).isoformat()


def save_meta(spark: SparkSession, path: str, meta: dict, mode: str = "append") -> None:
    """One more state of the index below path; the one written last holds."""
    line = json.dumps(meta | {"version": __version__, "written": _now()})
    spark.range(1).select(F.lit(line).alias("value")).coalesce(1).write.mode(mode).text(f"{path}/meta")


def read_meta(spark: SparkSession, path: str) -> dict:
    """k, classes and mst (whether they are stored), version, written, and what build noted of itself: cutoff, format, inputs, started, ended."""
    return max((json.loads(r["value"]) for r in spark.read.text(f"{path}/meta").collect()), key=lambda m: m["written"])  # a line for each state


def save_tree(index: Index, path: str, color_mst: DataFrame, keep_classes: bool = True) -> None:
    """The tree is added to the index below path, whose other tables stay as they are; the stored classes are emptied if they aren't kept."""
    spark = index.dbg.sparkSession
    meta = read_meta(spark, path)
    if keep_classes and not meta["classes"]:  # they come from the stored tree, which is about to be replaced
        stored(index.color_classes, "classes").write.mode("overwrite").parquet(f"{path}/color_classes")
    color_mst.write.mode("overwrite").parquet(f"{path}/color_mst")
    save_meta(spark, path, meta | {"classes": keep_classes, "mst": True})
    if not keep_classes:
        spark.createDataFrame([], "color_id long, samples array<int>, abundance long").write.mode("overwrite").parquet(f"{path}/color_classes")


def save_index(index: Index, path: str, color_mst: DataFrame | None = None, keep_classes: bool = True, build: dict | None = None) -> None:
    """Tables below path; the graph is laid out by k-mer range, so lookups of few k-mers skip files. Classes may be left out if a tree stands for them; build goes to the meta table."""
    if not keep_classes and color_mst is None:
        raise ValueError("classes can be dropped only if there is a tree")
    index.dbg.repartitionByRange("kmer").sortWithinPartitions("kmer").write.mode("overwrite").parquet(f"{path}/dbg")
    index.experiments.write.mode("overwrite").parquet(f"{path}/experiments")
    if keep_classes:
        index.color_classes.write.mode("overwrite").parquet(f"{path}/color_classes")
    if color_mst is not None:
        color_mst.write.mode("overwrite").parquet(f"{path}/color_mst")
    save_meta(index.dbg.sparkSession, path, (build or {}) | {"ended": _now(), "k": index.k, "classes": keep_classes, "mst": color_mst is not None}, "overwrite")


def load_index(spark: SparkSession, path: str, decoded: bool = True) -> tuple[Index, DataFrame | None]:
    """The index and its tree, if it has one; classes that are not stored are decoded from the tree, or None if they need not be."""
    from ..operators.mst import decode

    meta = read_meta(spark, path)
    tree = spark.read.parquet(f"{path}/color_mst") if meta["mst"] else None
    dbg = spark.read.parquet(f"{path}/dbg")
    if meta["classes"]:
        classes = spark.read.parquet(f"{path}/color_classes")
    elif not decoded:
        classes = None
    else:
        counts = dbg.groupBy("color_id").agg(F.count("*").alias("abundance"))
        classes = decode(tree).join(counts, "color_id").select("color_id", "samples", "abundance")
    return Index(meta["k"], dbg, classes, spark.read.parquet(f"{path}/experiments")), tree


def result_text(result: DataFrame, header: DataFrame, label: str = "") -> DataFrame:
    """(qid, value): for each query of header (qid, num_kmers) a block of lines: label and qid, number; then each sample and its count."""
    lines = F.transform(F.sort_array(F.collect_list(F.struct("sample", "n"))), lambda r: F.concat_ws("\t", r["sample"], r["n"].cast("string")))
    body = result.groupBy("qid").agg(F.array_join(lines, "\n").alias("body"))
    head = F.concat_ws("\t", F.concat(F.lit(label), F.col("qid").cast("string")), F.col("num_kmers").cast("string"))
    return header.join(body, "qid", "left").select("qid", F.concat_ws("\n", head, "body").alias("value"))


def result_json(result: DataFrame, header: DataFrame) -> DataFrame:
    """(qid, value): a JSON object with qnum, num_kmers and res for each query."""
    pairs = F.map_from_entries(F.sort_array(F.collect_list(F.struct("sample", "n"))))
    body = result.groupBy("qid").agg(pairs.alias("res"))
    none = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<bigint>"))
    return header.join(body, "qid", "left").select("qid", F.to_json(F.struct(F.col("qid").alias("qnum"), "num_kmers", F.coalesce("res", none).alias("res"))).alias("value"))


def write_blocks(blocks: DataFrame, path: str) -> None:
    """Blocks (qid, value) as text files in the order of qid."""
    blocks.repartitionByRange("qid").sortWithinPartitions("qid").select("value").write.mode("overwrite").text(path)
