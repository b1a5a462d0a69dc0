"""What the operators of this package have in common: tables, written intermediates, components."""

from __future__ import annotations

import atexit
import gc
import shutil
import tempfile
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of one Arrow batch; texts may be long, so batches have few rows.
ROWS_PER_BATCH = 500
#: Bytes of text that are analysed at a time inside a task (one longer text is still taken whole).
SLICE_BYTES = 1 << 19


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def tune(spark: SparkSession) -> None:
    """Small Arrow batches: the memory of a Python worker follows the texts of one batch."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ROWS_PER_BATCH))


_own: list[str] = []


def shared_folder(spark: SparkSession) -> str:
    """The folder that the session names in spark.checkpoint.dir. Where it names none: one that ends with the process if all runs in it, else one in the warehouse."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        return f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_written"
    if not _own:
        _own.append(tempfile.mkdtemp(prefix="written-"))
        atexit.register(shutil.rmtree, _own[0], ignore_errors=True)
    return _own[0]


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a table in the shared folder, read back: lineage ends there, and a lost executor costs a reread."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    gc.collect()
    spark.sparkContext._jvm.System.gc()  # the shuffle files behind the table are of no more use
    return spark.read.schema(df.schema).parquet(path)


def components(edges: DataFrame) -> DataFrame:
    """(node, component): the smallest node reachable over edges (a, b), for all nodes with an edge to another.

    Alternates large-star and small-star; each step is an aggregate of minima (combined before the
    shuffle) and a join, so a node of any degree is never gathered in one place.
    """
    e = written(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    last = None
    while True:
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = written(small.union(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct(), "edges")
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == last:
            break
        last = now
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).union(
        e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )


# --- texts as arrays ---------------------------------------------------------------------------------

#: Separators of a word in the sense of [^\x20\x09-\x0D]+, by byte.
SPACES = np.zeros(256, bool)
SPACES[[9, 10, 11, 12, 13, 32]] = True

_POWERS: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base ** 0 .. base ** (n - 1), modulo 2 ** 64."""
    have = _POWERS.get(base)
    if have is None or len(have) < n:
        out = np.full(max(n, 1 << 16), base, np.uint64)
        out[0] = 1
        have = _POWERS[base] = np.multiply.accumulate(out)
    return have[:n]


def mixed(h: np.ndarray, seed: int = 0) -> np.ndarray:
    """A bijective scramble of 64-bit values."""
    h = h ^ np.uint64(seed)
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def slices(batches, column: int, limit: int = SLICE_BYTES):
    """Record batches whose texts have about limit bytes together, at least one row each; nulls are empty texts."""
    for b in batches:
        t = b.column(column)
        if pa.types.is_large_string(t.type):
            t = t.cast(pa.string())
        if t.null_count:
            t = pc.fill_null(t, "")
        off = np.frombuffer(t.buffers()[1], np.int32)[t.offset : t.offset + len(t) + 1] if len(t) else np.zeros(1, np.int32)
        lo = 0
        while lo < len(t):
            hi = max(lo + 1, int(np.searchsorted(off, off[lo] + limit, side="right")) - 1)
            hi = min(hi, len(t))
            yield b.slice(lo, hi - lo), t.slice(lo, hi - lo)
            lo = hi


class Words:
    """Words of several texts: data has the bytes; word w is data[starts[w]:ends[w]] and belongs to row[w]; first[r] is the first word of row r."""

    def __init__(self, t: pa.Array, separators: np.ndarray = SPACES):
        n = len(t)
        off = np.frombuffer(t.buffers()[1], np.int32)[t.offset : t.offset + n + 1].astype(np.int64)
        buf = t.buffers()[2]
        self.data = np.frombuffer(buf, np.uint8)[off[0] : off[-1]] if buf is not None else np.zeros(0, np.uint8)
        self.offsets = off - off[0]
        word = ~separators[self.data]
        size = len(word)
        begin, end = word.copy(), word.copy()
        if size:
            begin[1:] &= ~word[:-1]
            end[:-1] &= ~word[1:]
            at = self.offsets[:-1]
            at = at[at < size]
            begin[at] = word[at]
            at = self.offsets[1:]
            at = at[at > 0] - 1
            end[at] = word[at]
        self.starts = np.flatnonzero(begin)
        self.ends = np.flatnonzero(end) + 1
        self.first = np.searchsorted(self.starts, self.offsets)
        self.row = np.repeat(np.arange(n), np.diff(self.first))

    def hashes(self) -> np.ndarray:
        """64-bit hash of each word's bytes."""
        base = 0x9E3779B97F4A7C15
        n = len(self.data)
        pw = powers(base, n + 1)
        inv = powers(pow(base, -1, 1 << 64), n + 1)
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum((self.data.astype(np.uint64) + np.uint64(1)) * pw[:n], out=sums[1:])
        return mixed((sums[self.ends] - sums[self.starts]) * inv[self.starts])


def grams(h: np.ndarray, n: int) -> np.ndarray:
    """64-bit hash of each run of n values of h; the runs may cross rows, which the caller masks."""
    m = len(h)
    if m < n:
        return np.zeros(0, np.uint64)
    base = 0xD6E8FEB86659FD93
    sums = np.zeros(m + 1, np.uint64)
    np.cumsum(h * powers(base, m), out=sums[1:])
    inv = powers(pow(base, -1, 1 << 64), m)
    return mixed((sums[n:] - sums[:-n]) * inv[: m - n + 1])


def forest(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest index joined to each of 0 .. n - 1 by pairs (a, b)."""
    label = np.arange(n)
    while len(a):
        low = np.minimum(label[a], label[b])
        old = label.copy()
        np.minimum.at(label, a, low)
        np.minimum.at(label, b, low)
        np.minimum.at(label, old[a], low)
        np.minimum.at(label, old[b], low)
        while (label[label] != label).any():
            label = label[label]
        if (label[a] == label[b]).all():
            break
    return label


def extended(df: DataFrame, text: str, make, fields: str) -> DataFrame:
    """df with the columns of fields (a DDL list), which make()(texts) computes as Arrow arrays for each slice of texts.

    Columns of df that have one of those names are replaced; all others pass through untouched.
    """
    from pyspark.sql.types import StructType

    new = StructType.fromDDL(fields).fieldNames()
    at = df.columns.index(text)
    packed = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row_"))

    def run(batches):
        f = make()
        for b in batches:
            t = pc.struct_field(b.column(0), [at])
            for rows, texts in slices([pa.RecordBatch.from_arrays([b.column(0), t], ["row_", "t"])], 1):
                yield pa.RecordBatch.from_arrays([rows.column(0), *f(texts)], ["row_", *new])

    schema = StructType(packed.schema.fields + StructType.fromDDL(fields).fields)
    kept = [F.col("row_").getField(c).alias(c) for c in df.columns if c not in new]
    return packed.mapInArrow(run, schema).select(*kept, *new)
