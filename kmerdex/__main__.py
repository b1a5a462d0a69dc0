"""Command line: python -m kmerdex VERB ... on the session that spark-submit or the environment configures."""

from __future__ import annotations

import argparse
import sys
from datetime import datetime, timezone
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import __version__
from .operators import index as X
from .operators import mst, stats, validate
from .operators.query import named, num_kmers, query, touched
from .operators.tables import stored
from .sources import io


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser("kmerdex", description=__doc__)
    p.add_argument("-v", "--version", action="version", version=__version__)
    verbs = p.add_subparsers(dest="verb", required=True)

    b = verbs.add_parser("build", help="index the samples of a list of paths")
    b.add_argument("-i", "--input-list", required=True)
    b.add_argument("-o", "--output", required=True)
    b.add_argument("-k", type=int, required=True)
    b.add_argument("-c", "--cutoff", type=int, default=1, help="least count of a k-mer in a sample")
    b.add_argument("-f", "--format", choices=("tokens", "fasta", "parquet"), default="tokens", help="parquet: tables (kmer, count) of canonical k-mers")
    b.add_argument("-e", "--class-distribution", action="store_true", help="also write (color_id, abundance)")

    m = verbs.add_parser("mst", help="encode the color classes along a spanning tree")
    m.add_argument("-p", "--index-prefix", required=True)
    keep = m.add_mutually_exclusive_group(required=True)
    keep.add_argument("-k", "--keep-classes", action="store_true")
    keep.add_argument("-d", "--delete-classes", action="store_true")

    q = verbs.add_parser("query", help="count k-mers of sequences in samples")
    q.add_argument("-1", "--use-classes", action="store_true", help="not the tree")
    q.add_argument("-j", "--json", action="store_true")
    q.add_argument("-k", type=int, help="k-mer length of the query, the index's by default")
    q.add_argument("-p", "--index-prefix", required=True)
    q.add_argument("-o", "--output", default="samples.output")
    q.add_argument("-f", "--format", choices=("tokens", "fasta"), default="tokens")
    q.add_argument("file")

    c = verbs.add_parser("validate", help="compare answers with the samples")
    c.add_argument("-i", "--input-list", required=True)
    c.add_argument("-p", "--index-prefix", required=True)
    c.add_argument("-f", "--format", choices=("tokens", "fasta", "parquet"), help="of the samples, as they were built by default")
    c.add_argument("file")

    t = verbs.add_parser("validatemst", help="compare the tree with the classes")
    t.add_argument("-p", "--index-prefix", required=True)

    s = verbs.add_parser("stats", help="statistics of the graph")
    s.add_argument("-p", "--index-prefix", required=True)
    s.add_argument("-t", "--type", choices=("mono", "cc_density", "color_dist", "jmerkmer"), default="mono")
    s.add_argument("-j", type=int, default=23)
    s.add_argument("-o", "--output", help="a folder; else the rows are counted and shown in part")
    return p


def samples(spark: SparkSession, listed: str, format: str, k: int, cutoff: int) -> tuple[DataFrame, DataFrame]:
    """experiments and (sample_id, kmer) of the listed paths; a sample is a path, its id the place in the list."""
    manifest = stored(io.read_manifest(spark, listed), "manifest")
    files = stored(io.files_of(spark, manifest), "files")
    paths = sorted({unquote(r["file"]) for r in files.select("file").collect()})  # the driver has listed them
    if not paths:
        raise ValueError("the list names no sample")
    if format == "parquet":
        found = spark.read.parquet(*paths).select(io.file_address(), "kmer", "count").where(F.col("count") >= cutoff)
    elif format == "fasta":
        found = io.fasta_records(spark, paths)
    else:
        found = spark.read.text(paths).select(io.file_address(), F.regexp_replace("value", r"\s+", "N").alias("seq"))  # white space parts sequences as an invalid base does
    fit = F.broadcast if len(paths) <= X.BROADCAST_SAMPLES else (lambda x: x)
    found = found.join(fit(files.select("file", "sample_id")), "file")
    experiments = manifest.withColumnRenamed("path", "sample")
    if format == "parquet":
        return experiments, found.select("sample_id", "kmer")
    return experiments, X.count_kmers(found, k, cutoff=cutoff).select("sample_id", "kmer")


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    a = parser().parse_args(argv)
    spark = spark or SparkSession.builder.appName("kmerdex").getOrCreate()
    if a.verb == "build":
        started = datetime.now(timezone.utc).isoformat()
        experiments, rows = samples(spark, a.input_list, a.format, a.k, a.cutoff)
        index = X.build_index(rows, experiments, a.k)
        io.save_index(index, a.output, build={"cutoff": a.cutoff, "format": a.format, "inputs": a.input_list, "started": started})
        if a.class_distribution:
            index.color_classes.select("color_id", "abundance").write.mode("overwrite").csv(f"{a.output}/class_distribution", sep="\t")
        return 0
    # a query through the tree decodes only the classes that it meets
    index, tree = io.load_index(spark, a.index_prefix, decoded=a.verb != "query" or a.use_classes)
    if a.verb == "mst":
        tree = stored(mst.encode(index), "tree")
        io.save_tree(index, a.index_prefix, tree, a.keep_classes)
    elif a.verb == "query":
        queries = io.read_sequences(spark, a.file, a.format)
        classes = index.color_classes if a.use_classes or tree is None else mst.decode(tree, touched(index, queries))
        answer = named(query(index, queries, a.k, classes), index.experiments)
        head = num_kmers(queries, a.k or index.k)
        if not a.json and a.k and a.k > index.k:  # there a text header has the length of the sequence
            head = queries.select("qid", F.length("seq").cast("long").alias("num_kmers"))
        io.write_blocks(io.result_json(answer, head) if a.json else io.result_text(answer, head, "" if a.use_classes else "seq"), a.output)
    elif a.verb == "validate":
        meta = io.read_meta(spark, a.index_prefix)
        _, rows = samples(spark, a.input_list, a.format or meta.get("format", "tokens"), index.k, meta.get("cutoff", 1))
        wrong = validate.validate(index, rows, io.read_sequences(spark, a.file)).count()
        print(f"{wrong} answers differ" if wrong else "all answers are right")
        return int(wrong > 0)
    elif a.verb == "validatemst":
        if tree is None:
            raise ValueError("the index has no tree")
        wrong = validate.validate_mst(index, tree).count()
        print(f"{wrong} classes differ" if wrong else "all classes are right")
        return int(wrong > 0)
    elif a.verb == "stats":
        found = stats.stats(index, a.type, a.j)
        if a.output:
            found.write.mode("overwrite").csv(a.output, sep="\t")
        else:
            found.show(50, truncate=False)
    return 0


if __name__ == "__main__":
    sys.exit(main())
