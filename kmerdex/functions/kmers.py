"""Words over A, C, G, T as string columns.

Bases are ordered C < A < T < G, and of a word and its reverse complement the larger one is canonical. Only
upper-case bases are valid; every other character breaks a sequence. All functions are built-in expressions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bases in ascending order; the place of a base is its digit.
BASES = "CATG"
DIGITS = "0123"
#: Windows of one piece of a run.
PIECE = 1 << 16


def digits(word: Column) -> Column:
    """The word in base-4 digits; equally long words compare like their digits."""
    return F.translate(word, BASES, DIGITS)


def from_digits(word: Column) -> Column:
    return F.translate(word, DIGITS, BASES)


def complement(word: Column) -> Column:
    return F.translate(word, "ACGT", "TGCA")


def reverse_complement(word: Column) -> Column:
    return F.reverse(complement(word))


def is_valid(word: Column) -> Column:
    return word.rlike("^[ACGT]+$")


def canonical(word: Column) -> Column:
    """The larger of the word and its reverse complement."""
    rc = reverse_complement(word)
    return F.when(digits(word) >= digits(rc), word).otherwise(rc)


def pack(word: Column) -> Column:
    """The word as a number of two bits a base; a word of more than 32 bases has none and raises an error."""
    number = F.conv(digits(word), 4, 10).cast("decimal(20,0)")
    return F.when(F.length(word) <= 32, number).when(word.isNotNull(), F.raise_error(F.lit("only words of up to 32 bases can be packed")).cast("decimal(20,0)"))


def unpack(number: Column, k: int) -> Column:
    return from_digits(F.lpad(F.conv(number.cast("string"), 10, 4), k, "0"))


def extend_right(word: Column, base: Column) -> Column:
    """Drop the first base and append one."""
    return F.concat(F.substring(word, 2, F.length(word)), base)


def extend_left(word: Column, base: Column) -> Column:
    """Drop the last base and put one in front."""
    return F.concat(base, F.substring(word, 1, F.length(word) - 1))


def concat(a: Column, b: Column) -> Column:
    return F.concat(a, b)


def prefix(word: Column, n: int) -> Column:
    return F.left(word, F.lit(n))


def suffix(word: Column, n: int) -> Column:
    return F.right(word, F.lit(n))


def has_period(word: Column, p: Column) -> Column:
    """Whether the word repeats with period p."""
    times = F.ceil(F.length(word) / p).cast("int")
    return F.right(F.repeat(F.right(word, p), times), F.length(word)) == word


def period(word: Column) -> Column:
    """The smallest period."""
    return F.array_min(F.filter(F.sequence(F.lit(1), F.length(word)), lambda p: has_period(word, p)))


def neighbors(df: DataFrame, kmer: str, *keep: str) -> DataFrame:
    """(keep, kmer, neighbor): canonical words that follow or precede each word in the graph, each once.

    The reverse complement and the digits of a word are made once for its eight extensions.
    """
    w = df.select(*keep, F.col(kmer).alias("kmer"), reverse_complement(F.col(kmer)).alias("rc"))
    w = w.select(*keep, "kmer", "rc", digits(F.col("kmer")).alias("d"), digits(F.col("rc")).alias("rd"))
    out = []
    for b in BASES:
        c, x, y = BASES[3 - BASES.index(b)], DIGITS[BASES.index(b)], DIGITS[3 - BASES.index(b)]
        tail, head = (lambda n: F.substring(F.col(n), 2, F.length(n))), (lambda n: F.substring(F.col(n), 1, F.length(n) - 1))
        right = F.concat(tail("d"), F.lit(x)) >= F.concat(F.lit(y), head("rd"))
        out.append(F.when(right, F.concat(tail("kmer"), F.lit(b))).otherwise(F.concat(F.lit(c), head("rc"))))
        left = F.concat(F.lit(x), head("d")) >= F.concat(tail("rd"), F.lit(y))
        out.append(F.when(left, F.concat(F.lit(b), head("kmer"))).otherwise(F.concat(tail("rc"), F.lit(c))))
    return w.select(*keep, "kmer", F.explode(F.array_distinct(F.array(*out))).alias("neighbor"))


def random_words(spark, n: int, length: int, seed: int = 0):
    """(id, word): n words of random bases, the same for the same seed however they are partitioned."""
    at = F.sequence(F.lit(1), F.lit(length))
    return spark.range(n).select("id", F.array_join(F.transform(at, lambda i: F.substring(F.lit(BASES), F.pmod(F.xxhash64(F.lit(seed), F.col("id"), i), F.lit(4)).cast("int") + 1, F.lit(1))), "").alias("word"))


def first_part(text: Column, separator: str) -> Column:
    return F.substring_index(text, separator, 1)


def last_part(text: Column, separator: str) -> Column:
    return F.substring_index(text, separator, -1)


def kmers(df: DataFrame, seq: str, k: int, *keep: str) -> DataFrame:
    """(keep, run, pos, kmer): every window of k valid bases in canonical form; runs of valid bases and places in them count from 1.

    A run is cut into pieces that overlap by k - 1 bases, so that no array grows with the run. The digits of a piece and of its
    reverse complement are made once; windows are cut from them as bytes, where cutting takes the same time at any place, inside generated code.
    """
    if k < 1:
        raise ValueError("k must be positive")
    runs = df.select(*keep, F.posexplode(F.split(F.col(seq), "[^ACGT]+")).alias("run", "whole")).where(F.length("whole") >= k)
    whole = F.col("whole").cast("binary")
    runs = runs.select(*keep, "run", F.explode(F.sequence(F.lit(0), F.floor((F.length("whole") - k) / PIECE).cast("int"))).alias("piece"), whole.alias("whole"))
    runs = runs.select(*keep, "run", "piece", F.substring(F.col("whole"), F.col("piece") * PIECE + 1, F.lit(PIECE + k - 1)).cast("string").alias("w"))
    rc = reverse_complement(F.col("w"))
    b = runs.select(
        *keep, (F.col("run") + 1).alias("run"), (F.col("piece") * PIECE).alias("base"), F.col("w").cast("binary").alias("w"), rc.cast("binary").alias("rc"),
        digits(F.col("w")).cast("binary").alias("d"), digits(rc).cast("binary").alias("rd"), F.length("w").alias("n"),
    )
    at = b.select(*keep, "run", "base", "w", "rc", "d", "rd", "n", F.explode(F.sequence(F.lit(1), F.col("n") - (k - 1))).alias("pos"))

    def cut(name, i):
        return F.substring(F.col(name), i, F.lit(k))

    back = F.col("n") - (k - 2) - F.col("pos")
    return at.select(*keep, "run", (F.col("base") + F.col("pos")).alias("pos"), F.when(cut("d", F.col("pos")) >= cut("rd", back), cut("w", F.col("pos"))).otherwise(cut("rc", back)).cast("string").alias("kmer"))


def register(spark) -> None:
    """SQL functions canonical_kmer(word) and reverse_complement(word), as expressions."""
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION reverse_complement(w STRING) RETURNS STRING RETURN reverse(translate(w, 'ACGT', 'TGCA'))")
    spark.sql(
        "CREATE OR REPLACE TEMPORARY FUNCTION canonical_kmer(w STRING) RETURNS STRING RETURN "
        "CASE WHEN translate(w, 'CATG', '0123') >= translate(reverse(translate(w, 'ACGT', 'TGCA')), 'CATG', '0123') THEN w ELSE reverse(translate(w, 'ACGT', 'TGCA')) END"
    )
