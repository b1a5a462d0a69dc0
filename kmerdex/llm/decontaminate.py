"""Benchmark decontamination: exact containment of item-sized word windows, by a prefix-filtered set join.

A window of an item is contained in a document only if all of its words are, so one necessary token, the
prefix of length one under any fixed order, is enough to find it. The order is by rarity: occurrences of
each item word over all documents. A document word that is some window's rarest word makes a candidate; the
positional bound (the window must fit between the document's first and last word) and then equality of the
whole word run decide. All of it is DataFrame code.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import shared

#: Bytes that separate words: all of ASCII but digits and lower-case letters (A-Z are lower-cased first).
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WINDOW = 10
#: Rows and bytes of windows that are sent to every executor; beyond either the tables are joined by a shuffle.
BROADCAST_WINDOWS, BROADCAST_BYTES = 200_000, 32 << 20
#: Stands behind the last word of each document; no word holds a space.
LAST = " "


def words(text: Column) -> Column:
    """Array of words of a text, A-Z lower-cased and nothing else; a null text has none."""
    plain = F.octet_length(text) == F.char_length(text)
    low = F.when(plain, F.lower(text)).otherwise(F.translate(text, string.ascii_uppercase, string.ascii_lowercase))
    return F.coalesce(F.array_remove(F.split(low, SEPARATORS), ""), F.array().cast("array<string>"))


def item_windows(items: DataFrame, item_id: str, text: str, window: int) -> DataFrame:
    """(item, win): every run of window words of each item; an item of fewer words, but not none, is one run."""
    w = items.select(F.coalesce(F.col(item_id).cast("string"), F.lit("")).alias("item"), words(F.col(text)).alias("w")).where("size(w) > 0")
    starts = F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("w") - (window - 1)))
    return w.select("item", "w", F.explode(starts).alias("i")).select("item", F.slice("w", F.col("i"), window).alias("win")).distinct()


def fitting(df: DataFrame, win: str = "win"):
    """broadcast if the rows of windows in df are few and short, else nothing."""
    n, size = df.agg(F.count("*"), F.sum(F.aggregate(win, F.lit(0).cast("long"), lambda a, x: a + F.octet_length(x) + 16))).first()
    return F.broadcast if n <= BROADCAST_WINDOWS and (size or 0) <= BROADCAST_BYTES else None


def contamination(
    docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = WINDOW
) -> DataFrame:
    """One row for each distinct (id, text) of docs: doc_id, text_key, n_words, copies, spans, items.

    spans are the occurrences as structs (start, n) of word positions from 0, items the sorted ids (as
    strings) of the items found. Null texts and empty ones have no words; an item with a null id counts
    under the empty id; a null doc_id is kept as an id of its own; repeated rows give one row, which has their
    number as copies; other columns of docs and items are ignored, whatever their names; empty tables give no rows or no hits.
    """
    spark = docs.sparkSession
    d = docs.select(F.col(doc_id).alias("doc_id"), F.xxhash64(F.col(text)).alias("text_key"), words(F.col(text)).alias("w"))
    found = shared.written(item_windows(items, item_id, item_text, window), "windows")
    wins = found.select("win").distinct()
    small = fitting(wins)
    fit = small or (lambda x: x)

    # rarity of the items' words over all documents
    vocabulary = wins.select(F.explode("win").alias("word")).distinct()
    count = d.select(F.explode("w").alias("word")).join(fit(vocabulary), "word").groupBy("word").agg(F.count("*").alias("n"))
    tokens = wins.select("win", F.posexplode("win").alias("at", "word")).join(count, "word", "left")
    # a word that no document has is the rarest of all: its windows can't occur
    rarest = tokens.groupBy("win").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "word", "at")).alias("t"))
    anchors = shared.written(rarest.where("t.n > 0").select(F.col("t.word").alias("word"), F.col("t.at").alias("at"), "win"), "anchors")

    # each row of docs also gives one row without a window, by which it is kept and counted
    start = F.col("pos") - F.col("at")
    fits = F.col("win").isNull() | ((start >= 0) & (start + F.size("win") <= F.size("w")) & (F.slice("w", F.greatest(start, F.lit(0)) + 1, F.size("win")) == F.col("win")))
    if small:
        end = spark.range(1).select(F.lit(LAST).alias("word"), F.lit(None).cast("int").alias("at"), F.lit(None).cast("array<string>").alias("win"))
        ended = d.select("doc_id", "text_key", "w", F.posexplode(F.concat("w", F.array(F.lit(LAST)))).alias("pos", "word"))
        seen = ended.join(F.broadcast(anchors.unionByName(end)), "word").where(fits)
    else:
        # only words that some window's rarity names are shuffled back to their documents
        where = d.select("doc_id", "text_key", F.posexplode("w").alias("pos", "word")).join(anchors, "word")
        where = where.groupBy(F.col("doc_id").alias("id_"), F.col("text_key").alias("key_")).agg(F.collect_set(F.struct("pos", "at", "win")).alias("c"))
        full = d.join(where, F.col("doc_id").eqNullSafe(F.col("id_")) & F.col("text_key").eqNullSafe(F.col("key_")), "left")
        none_ = F.array(F.struct(F.lit(None).cast("int").alias("pos"), F.lit(None).cast("int").alias("at"), F.lit(None).cast("array<string>").alias("win")))
        seen = full.select("doc_id", "text_key", "w", F.inline(F.concat(none_, F.coalesce("c", F.slice(none_, 1, 0))))).where(fits)
    seen = seen.select("doc_id", "text_key", F.size("w").alias("n_words"), start.alias("start"), "win")
    by = seen.groupBy("doc_id", "text_key").agg(
        F.max("n_words").alias("n_words"),
        F.count_if(F.col("win").isNull()).alias("copies"),
        F.collect_set(F.when(F.col("win").isNotNull(), F.struct("start", F.size("win").alias("n")))).alias("spans"),
        F.collect_set("win").alias("wins"),
    )
    by = shared.written(by, "hits")
    few = (small and fitting(found)) or (lambda x: x)  # one window may be of any number of items
    named = by.select("doc_id", "text_key", F.explode("wins").alias("win")).join(few(found), "win")
    named = named.groupBy(F.col("doc_id").alias("id_"), F.col("text_key").alias("key_")).agg(F.sort_array(F.collect_set("item")).alias("items"))
    none = F.array().cast("array<string>")
    return by.join(named, F.col("doc_id").eqNullSafe(F.col("id_")) & F.col("text_key").eqNullSafe(F.col("key_")), "left").select(
        "doc_id", "text_key", "n_words", "copies", F.sort_array("spans").alias("spans"), F.coalesce("items", none).alias("items")
    )


def covered(spans: Column) -> Column:
    """Number of words in the union of sorted spans (start, n)."""
    zero = F.struct(F.lit(0).alias("end"), F.lit(0).alias("n"))

    def step(acc, s):
        stop = s["start"] + s["n"]
        return F.struct(F.greatest(acc["end"], stop).alias("end"), (acc["n"] + F.greatest(F.lit(0), stop - F.greatest(acc["end"], s["start"]))).alias("n"))

    return F.aggregate(spans, zero, step, lambda acc: acc["n"])


def clean(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The rows of docs (columns doc_id and text) that hold no window of any item, unchanged."""
    bad = contamination(docs, items).where("size(spans) > 0").select(F.col("doc_id").alias("id_"), F.col("text_key").alias("key_"))
    return docs.join(bad, F.col("doc_id").eqNullSafe(F.col("id_")) & (F.xxhash64("text") == F.col("key_")), "left_anti")


def op9_decontaminate(spark, sf_dir: str) -> DataFrame:
    """Words of each document that lie in windows of benchmark items; one row for each row of documents, also where they repeat. A null text has no words."""
    found = contamination(shared.read(spark, sf_dir, "documents"), shared.read(spark, sf_dir, "benchmark"))
    hit = covered(F.col("spans"))
    found = found.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), "copies")))
    return found.select(
        "doc_id",
        F.col("n_words").cast("long").alias("n_words"),
        hit.cast("long").alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "items").cast("binary"), 256).alias("items_sha256"),
        (hit > 0).alias("contaminated"),
    )


SQL = r"""
WITH lowered AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
items AS (
  SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
wins AS (
  SELECT DISTINCT item, list_slice(w, i, i + 9) AS win
  FROM (SELECT item, w, unnest(generate_series(1, greatest(1, len(w) - 9))) AS i FROM items WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT len(win) AS n FROM wins),
runs AS (
  SELECT doc_id, i, n, list_slice(w, i, i + n - 1) AS win
  FROM (SELECT doc_id, w, n, unnest(generate_series(1, len(w) - n + 1)) AS i FROM lowered, sizes WHERE len(w) >= n)),
occ AS (SELECT doc_id, i, n, item FROM runs JOIN wins USING (win)),
hit AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT DISTINCT doc_id, unnest(generate_series(i, i + n - 1)) AS p FROM occ) GROUP BY doc_id),
named AS (SELECT doc_id, count(DISTINCT item) AS n_items, string_agg(item, ',' ORDER BY item) AS s FROM (SELECT DISTINCT doc_id, item FROM occ) GROUP BY doc_id)
SELECT l.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(s, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM lowered l LEFT JOIN hit USING (doc_id) LEFT JOIN named USING (doc_id)
"""
