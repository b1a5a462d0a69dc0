"""Building the index: canonical k-mers to dictionary-encoded sets of samples."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.kmers import kmers
from ..functions.packed import among
from .tables import numbered, stored


#: Samples in one number, samples for which sets are built as bits, sample names that are broadcast.
WORD, BIT_SAMPLES, BROADCAST_SAMPLES = 62, 992, 1_000_000


@dataclass
class Index:
    """k, dbg(kmer, color_id), color_classes(color_id, samples, abundance), experiments(sample_id, sample)."""

    k: int
    dbg: DataFrame
    color_classes: DataFrame
    experiments: DataFrame


def count_kmers(reads: DataFrame, k: int, seq: str = "seq", sample: str = "sample_id", cutoff: int = 1) -> DataFrame:
    """(sample_id, kmer, count): the k-mer multiset of each sample, without k-mers rarer than cutoff."""
    out = kmers(reads, seq, k, sample).groupBy(F.col(sample).alias("sample_id"), "kmer").agg(F.count("*").alias("count"))
    return out.where(F.col("count") >= cutoff) if cutoff > 1 else out


def number_samples(names: DataFrame, name: str = "sample") -> DataFrame:
    """experiments(sample_id, sample): distinct names, numbered in their order."""
    return numbered(names.select(F.col(name).alias("sample")).where("sample is not null").distinct(), "sample_id", F.col("sample")).select(F.col("sample_id").cast("int").alias("sample_id"), "sample")


def sample_sets(sample_kmers: DataFrame) -> DataFrame:
    """(kmer, samples): the sorted set of samples of each k-mer, whatever the counts; one shuffle for any number of samples."""
    return sample_kmers.groupBy("kmer").agg(F.sort_array(F.collect_set("sample_id")).alias("samples"))


def color_dictionary(sets: DataFrame) -> DataFrame:
    """color_classes(color_id, samples, abundance): distinct sets, the most abundant first."""
    classes = sets.groupBy("samples").agg(F.count("*").alias("abundance"))
    return numbered(classes, "color_id", F.desc("abundance"), F.col("samples")).select("color_id", "samples", "abundance")


def _word(i: int) -> str:
    return f"_bits{i}"


def _bit_sets(sample_kmers: DataFrame, words: int) -> DataFrame:
    """(kmer, _bits0, ...): sets as bits of long numbers, which the hash aggregate can or in generated code."""
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), (F.col("sample_id") % WORD).cast("int"))
    at = F.floor(F.col("sample_id") / WORD)
    bits = [F.when(at == i, bit).otherwise(F.lit(0).cast("long")).alias(_word(i)) for i in range(words)]
    return sample_kmers.select("kmer", *bits).groupBy("kmer").agg(*[F.bit_or(_word(i)).alias(_word(i)) for i in range(words)])


def _members(words: int, samples: int) -> Column:
    """Sorted array of the samples whose bits are set."""
    bits = F.array(*[F.col(_word(i)) for i in range(words)])
    ids = F.sequence(F.lit(0), F.lit(samples - 1))
    return F.filter(ids, lambda s: F.call_function("shiftright", F.element_at(bits, F.floor(s / WORD).cast("int") + 1), (s % WORD).cast("int")).bitwiseAND(F.lit(1).cast("long")) == 1)


def build_index(sample_kmers: DataFrame, experiments: DataFrame, k: int) -> Index:
    """The index of rows (sample_id, kmer); raises if there is no sample.

    Up to BIT_SAMPLES samples, sets are bits until the dictionary is made, and only its classes become arrays.
    """
    samples = experiments.count()
    if not samples:
        raise ValueError("no samples")
    if samples > BIT_SAMPLES:
        sets = stored(sample_sets(sample_kmers), "sets")
        classes = stored(color_dictionary(sets), "classes")
        return Index(k, stored(sets.join(classes.select("samples", "color_id"), "samples").select("kmer", "color_id"), "dbg"), classes, experiments)
    words = -(-samples // WORD)
    names = [_word(i) for i in range(words)]
    sets = stored(_bit_sets(sample_kmers, words), "sets")
    found = sets.groupBy(*names).agg(F.count("*").alias("abundance")).withColumn("samples", _members(words, samples))
    found = stored(numbered(found, "color_id", F.desc("abundance"), F.col("samples")), "classes")
    dbg = stored(sets.join(found.select(*names, "color_id"), names).select("kmer", "color_id"), "dbg")
    return Index(k, dbg, found.select("color_id", "samples", "abundance"), experiments)


def index_reads(reads: DataFrame, k: int, seq: str = "seq", sample: str = "sample", cutoff: int = 1, only: DataFrame | None = None) -> Index:
    """The index of reads (sample, seq).

    With only (kmer), it is built for these k-mers alone, and others are dropped where they are cut: every read is read, and queries of these k-mers
    get the answers of the whole index, as a k-mer's set of samples does not depend on other k-mers. Color ids are ranks among the sets that are left.
    """
    experiments = stored(number_samples(reads, sample), "experiments")
    # the names go to the reads wherever their number allows; a sample may have any share of the reads
    fit = F.broadcast if experiments.count() <= BROADCAST_SAMPLES else (lambda x: x)
    named = reads.join(fit(experiments.select(F.col("sample").alias(sample), "sample_id")), sample).select("sample_id", seq)
    if only is not None:
        found = among(named, seq, k, only, "sample_id")
        counted = found.groupBy("sample_id", "kmer").agg(F.count("*").alias("count")).where(F.col("count") >= cutoff) if cutoff > 1 else found
    else:
        counted = count_kmers(named, k, seq, "sample_id", cutoff) if cutoff > 1 else kmers(named, seq, k, "sample_id").select("sample_id", "kmer")
    return build_index(counted, experiments, k)


def cardinality(index: Index) -> DataFrame:
    """One row: n_kmers, n_classes, n_samples."""
    a = index.dbg.agg(F.count("*").alias("n_kmers"))
    b = index.color_classes.agg(F.count("*").alias("n_classes"))
    c = index.experiments.agg(F.count("*").alias("n_samples"))
    return a.join(b, F.lit(True)).join(c, F.lit(True))


def repeated_keys(index: Index) -> DataFrame:
    """k-mers that are in the index more than once; there must be none."""
    return index.dbg.groupBy("kmer").count().where("count > 1")
