"""Words over A, C, G, T as numbers of two bits a base, cut by numpy inside Arrow batches; for k up to 31.

Numbers are those of kmers.pack, and the same windows are cut as by kmers.kmers. No window is shuffled here: a text's
windows are summed up, or held against the words that are asked for, in the task that reads the text.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kmers as K

#: The longest word that a signed number holds; bytes cut at a time inside a task; rows of an Arrow batch; words that are broadcast.
LONGEST, SLICE, BATCH, BROADCAST_WORDS = 31, 1 << 20, 500, 1_000_000

DIGIT = np.full(256, 4, np.uint8)
DIGIT[np.frombuffer(K.BASES.encode(), np.uint8)] = np.arange(4)


def cut(data: np.ndarray, begin: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(number, text) of every window of k bases in canonical form; text t has the bytes begin[t]:begin[t + 1] of data."""
    n = len(data) - k + 1
    if n < 1:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    d = DIGIT[data]
    text = np.repeat(np.arange(len(begin) - 1), np.diff(begin))
    bad = np.r_[0, np.cumsum(d > 3)]
    valid = (bad[k:] == bad[:-k]) & (text[k - 1 :] == text[:n])
    x = (d & 3).astype(np.int64)
    # words whose lengths are powers of two, and their reverse complements, put together to length k
    word, back, size, w, b, p = None, None, 0, x, 3 - x, 1
    while p <= k:
        if k & p:
            m = len(x) - size - p + 1
            word, back = (w, b) if not size else (word[:m] << 2 * p | w[size : size + m], back[:m] | b[size : size + m] << 2 * size)
            size += p
        m = len(x) - 2 * p + 1
        if 2 * p <= k:
            w, b = w[:m] << 2 * p | w[p : p + m], b[:m] | b[p : p + m] << 2 * p
        p *= 2
    return np.maximum(word, back)[valid], text[:n][valid]


def _slices(batches, column: int):
    """(batch, data, begin) of about SLICE bytes of text, at least one row each; null texts are empty."""
    for b in batches:
        t = pc.fill_null(b.column(column).cast(pa.large_string()), "")
        if not len(t):
            continue
        off = np.frombuffer(t.buffers()[1], np.int64)[t.offset : t.offset + len(t) + 1]
        data = np.frombuffer(t.buffers()[2], np.uint8) if t.buffers()[2] is not None else np.zeros(0, np.uint8)
        lo = 0
        while lo < len(t):
            hi = min(len(t), max(lo + 1, int(np.searchsorted(off, off[lo] + SLICE, side="right")) - 1))
            yield b.slice(lo, hi - lo), data[off[lo] : off[hi]], off[lo : hi + 1] - off[lo]
            lo = hi


def _mapped(df: DataFrame, seq: str, keep: tuple[str, ...], f, ddl: str) -> DataFrame:
    """df's columns keep, and those of ddl that f(data, begin) makes: (rows, arrays), the row of each new one."""
    spark = df.sparkSession
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH))
    taken = df.select(*keep, F.col(seq).alias("_seq"))
    names = [*keep, *(c.split()[0] for c in ddl.split(","))]

    def run(batches):
        for b, data, begin in _slices(batches, len(keep)):
            row, arrays = f(data, begin)
            yield pa.RecordBatch.from_arrays([*(b.column(i).take(pa.array(row)) for i in range(len(keep))), *map(pa.array, arrays)], names)

    kept = ", ".join(f"`{c.name}` {c.dataType.simpleString()}" for c in taken.schema.fields[:-1])
    return taken.mapInArrow(run, f"{kept}, {ddl}" if kept else ddl)


def _fits(k: int) -> None:
    if not 1 <= k <= LONGEST:
        raise ValueError(f"k must be between 1 and {LONGEST}")


def summed(df: DataFrame, seq: str, k: int, *keep: str) -> DataFrame:
    """(keep, n_windows, n_kmers, least, greatest) of each row's own windows; rows without a window are left out.

    The least and the greatest are those of the texts (A < C < G < T), as numbers. A row's windows are sorted in its task, so its memory follows the longest text.
    """
    _fits(k)
    swap = np.int64(sum(1 << 2 * i for i in range(k)))  # C and A, and T and G, change places: the order of texts

    def sums(data, begin):
        number, text = cut(data, begin, k)
        at = np.searchsorted(text, np.arange(len(begin)))
        row = np.flatnonzero(np.diff(at))
        n, different, least, greatest = np.diff(at)[row], np.zeros(len(row), np.int64), np.zeros(len(row), np.int64), np.zeros(len(row), np.int64)
        for i, r in enumerate(row):
            x = np.sort(number[at[r] : at[r + 1]] ^ swap)
            different[i], least[i], greatest[i] = 1 + np.count_nonzero(x[1:] != x[:-1]), x[0] ^ swap, x[-1] ^ swap
        return row, [n.astype(np.int64), different, least, greatest]

    return _mapped(df, seq, keep, sums, "n_windows long, n_kmers long, least long, greatest long")


def among(df: DataFrame, seq: str, k: int, words: DataFrame, *keep: str) -> DataFrame:
    """(keep, kmer): the windows that kmers.kmers cuts and that are among words (kmer); others are dropped where they are cut, if words can be broadcast."""
    few = F.broadcast if words.limit(BROADCAST_WORDS + 1).count() <= BROADCAST_WORDS else (lambda x: x)
    words = words.select("kmer").where(F.length("kmer") == k).distinct()
    if k > LONGEST:
        return K.kmers(df, seq, k, *keep).select(*keep, "kmer").join(few(words), "kmer", "left_semi")
    _fits(k)

    def numbers(data, begin):
        number, text = cut(data, begin, k)
        return text, [number]

    # the word's text comes from words: made of the number, it would be made for every window where a later join on it is pushed down
    numbered = words.select("kmer", K.pack(F.col("kmer")).cast("long").alias("_number"))
    return _mapped(df, seq, keep, numbers, "_number long").join(few(numbered), "_number").select(*keep, "kmer")
