"""Substring dedup: windows of words that an earlier document has are removed, by suffix automata.

1. Anchors. The anchor of a window is the smallest hash among its runs of GRAM words, so equal windows have
   equal anchors. An anchor that only one document has rules its windows out. The smallest document with
   an anchor is the anchor's owner, and no document before the owner can have one of its windows.
2. Reference shards. The passages of an owner whose windows have anchors it owns are a shard. The passages of
   other documents that have the same owner are dealt to salts of it, as many as their number asks for, and the
   shard is replicated to each salt: one suffix automaton for a salt (in parts of bounded size), however hot its owner.
   Shards as a whole grow with the corpus, so none is sent to all executors.
3. Matching statistics. Each passage is streamed through its shard's automaton; where the longest match is
   as long as a window, the owner has that window, and its words go.
4. Windows with a shared anchor that the owner itself lacks are few: the same round is run for them once more
   with the hash of the whole window as anchor, so that their owner does have them, and again with
   another hash as long as collisions leave any.

Nothing is decided by hashes: they propose owners, automata over the words themselves decide.
"""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import shared

WINDOW = 50
GRAM = 30
#: Words of a reference shard that one automaton holds.
SHARD_WORDS = 200_000
#: Passages that one copy of a shard is asked for, about; owners with more than that many which are broadcast at most.
PROBES, BROADCAST_OWNERS = 256, 100_000
#: Windows of a passage; longer runs are cut, so that the copies of a long document are dealt to salts, too, and a batch of passages is bounded.
PIECE = 16_384


class Automaton:
    """Suffix automaton of a sequence of hashable symbols."""

    def __init__(self, sequence):
        nexts, link, length = [{}], [-1], [0]
        last = 0
        for c in sequence:
            cur = len(nexts)
            nexts.append({})
            length.append(length[last] + 1)
            link.append(0)
            p = last
            while p >= 0 and c not in nexts[p]:
                nexts[p][c] = cur
                p = link[p]
            if p >= 0:
                q = nexts[p][c]
                if length[q] == length[p] + 1:
                    link[cur] = q
                else:
                    clone = len(nexts)
                    nexts.append(nexts[q].copy())
                    length.append(length[p] + 1)
                    link.append(link[q])
                    link[q] = link[cur] = clone
                    while p >= 0 and nexts[p].get(c) == q:
                        nexts[p][c] = clone
                        p = link[p]
            last = cur
        self.nexts, self.link, self.length = nexts, link, length

    def ends(self, sequence, least: int) -> list[int]:
        """Positions of sequence at which the longest suffix that occurs here has least symbols or more."""
        nexts, link, length = self.nexts, self.link, self.length
        v = n = 0
        out = []
        for i, c in enumerate(sequence):
            to = nexts[v].get(c)
            if to is None:
                while v >= 0 and c not in nexts[v]:
                    v = link[v]
                if v < 0:
                    v = n = 0
                    continue
                n = length[v]
                to = nexts[v][c]
            v = to
            n += 1
            if n >= least:
                out.append(i)
        return out


def shards(passages: Iterable[list[bytes]], window: int, most: int):
    """Sequences of at most about most words that have every window of the passages; passages are kept apart by numbers."""
    part: list = []
    for i, words in enumerate(passages):
        for at in range(0, max(1, len(words) - window + 1), most):
            piece = words[at : at + most + window - 1]
            if part and len(part) + len(piece) > most:
                yield part
                part = []
            part += piece
            part.append(i)
    if part:
        yield part


def sliding_min(h: np.ndarray, width: int) -> np.ndarray:
    have, out = 1, h
    while have * 2 <= width:
        out = np.minimum(out[: len(out) - have], out[have:])
        have *= 2
    return np.minimum(out[: len(out) - (width - have)], out[width - have :]) if have < width else out


def windows(w: shared.Words, window: int, gram: int, round_: int) -> tuple[np.ndarray, np.ndarray]:
    """First word and anchor of every window; in round 0 the smallest of its runs' hashes, later the window's own under another seed."""
    m = len(w.starts)
    if m < window:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    h = w.hashes()
    keys = sliding_min(shared.grams(h, gram), window - gram + 1) if round_ == 0 else shared.mixed(shared.grams(h, window), round_)
    at = np.flatnonzero(w.row[: m - window + 1] == w.row[window - 1 :])
    return at, keys[at].view(np.int64)


def _anchors(batches, window, gram, kind):
    for b in batches:
        for rows, texts in shared.slices([b], 1):
            w = shared.Words(texts)
            at, key = windows(w, window, gram, 0)
            row = w.row[at]
            order = np.lexsort((key, row))
            row, key = row[order], key[order]
            new = np.r_[True, (row[1:] != row[:-1]) | (key[1:] != key[:-1])] if len(row) else np.zeros(0, bool)
            yield pa.RecordBatch.from_arrays([pa.array(key[new]), rows.column(0).take(pa.array(row[new]))], ["key", "id"])


def _passages(batches, window, gram, round_, piece=PIECE):
    """Runs of windows of one owner, cut after piece windows, as (owner, id, th, start, body); every window is in one of them."""
    for b in batches:
        for rows, texts in shared.slices([b], 2):
            w = shared.Words(texts)
            at, key = windows(w, window, gram, round_)
            bounds = np.searchsorted(w.row[at], np.arange(len(texts) + 1))
            raw = w.data.tobytes()
            index, owners, start, body = [], [], [], []
            marks, owner = rows.column(3), rows.column(4)
            for r in range(len(texts)):
                k, a = key[bounds[r] : bounds[r + 1]], at[bounds[r] : bounds[r + 1]]
                if not len(k):
                    continue
                known = marks[r].values.to_numpy(zero_copy_only=False)
                whose = owner[r].values
                order = np.argsort(known)
                i = np.minimum(np.searchsorted(known, k, sorter=order), len(known) - 1)
                i = order[i]
                hit = known[i] == k
                codes = pa.compute.dictionary_encode(whose).indices.to_numpy(zero_copy_only=False)
                code = np.where(hit, codes[i], -1)
                edge = np.flatnonzero(np.r_[True, code[1:] != code[:-1], True])
                for x, y in zip(edge[:-1].tolist(), edge[1:].tolist()):
                    for z in range(x, y, piece) if code[x] >= 0 else ():
                        index.append(r)
                        owners.append(whose[int(i[x])].as_py())
                        start.append(int(a[z] - w.first[r]))
                        body.append(raw[w.starts[a[z]] : w.ends[a[min(z + piece, y) - 1] + window - 1]])
            take = pa.array(index, pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(owners, rows.column(0).type), rows.column(0).take(take), rows.column(1).take(take), pa.array(start, pa.int32()), pa.array(body, pa.binary())], ["owner", "id", "th", "start", "body"])


def _matched(batches, window, gram, next_round, most):
    """For each passage: spans [s, e) of words that are covered by its owner's windows, and anchors of the next round for windows that aren't.

    Rows are sorted by (owner, salt), the owner's own passages (probe is false) before those that are streamed through its automaton.
    A batch is held as bytes: passages are split one at a time, and hashed a slice at a time, as copies of a long text fill a batch.
    """
    kind = pa.list_(pa.struct([("s", pa.int32()), ("e", pa.int32())]))
    now, refs, auto = None, [], None
    for b in batches:
        owner, salt, probe, ids, th, start, body = b.columns
        keys = list(zip(owner.to_pylist(), salt.to_pylist(), probe.to_pylist()))
        n = b.num_rows
        covered: list = [None] * n
        lo = 0
        while lo < n:
            hi = lo
            while hi < n and keys[hi] == keys[lo]:
                hi += 1
            if keys[lo][:2] != now:
                now, refs, auto = keys[lo][:2], [], None
            if not keys[lo][2]:
                refs += body.slice(lo, hi - lo).to_pylist()
                lo = hi
                continue
            # a shard of one part keeps its automaton for the batches to come, of several each goes before the next is built
            parts = [None] if auto is not None else shards((x.split() for x in refs), window, most)
            count = 0
            for part in parts:
                count += 1
                if part is not None:
                    auto = None
                    auto = Automaton(part)
                for i in range(lo, hi):
                    x = body[i].as_py().split()
                    if covered[i] is None:
                        covered[i] = np.zeros(max(0, len(x) - window + 1), bool)
                    covered[i][np.array(auto.ends(x, window), np.int64) - (window - 1)] = True
            auto = auto if count == 1 else None
            lo = hi
        first = 0
        for rows, texts in shared.slices([pa.RecordBatch.from_arrays([probe, ids, th, start, body.cast(pa.binary())], ["probe", "id", "th", "start", "body"])], 4):
            at = pa.array(np.flatnonzero(rows.column(0).to_numpy(zero_copy_only=False)))
            hits = [covered[first + i] for i in at.to_pylist()]
            first += rows.num_rows
            rows, got = rows.take(at), shared.Words(texts.take(at))
            where, key = windows(got, window, gram, next_round)
            bounds = np.searchsorted(got.row[where], np.arange(len(hits) + 1))
            spans: list = []
            misses: list = []
            for i, (c, base) in enumerate(zip(hits, rows.column(3).to_pylist())):
                edge = np.flatnonzero(np.diff(np.r_[False, c, False].astype(np.int8)))
                spans.append([{"s": base + int(s), "e": base + int(e) + window - 1} for s, e in zip(edge[::2], edge[1::2])])
                misses.append(np.unique(key[bounds[i] : bounds[i + 1]][~c]))
            yield pa.RecordBatch.from_arrays([rows.column(1), rows.column(2), pa.array(spans, kind), pa.array(misses, pa.list_(pa.int64()))], ["id", "th", "spans", "missed"])


def _dealt(cut: DataFrame, probes: int) -> DataFrame:
    """Passages by (owner, salt): an owner's own passages, each once, go to all of its salts, those of others to one salt; a salt has about so many."""
    hot = cut.where("id > owner").groupBy("owner").agg(F.ceil(F.count("*") / probes).cast("int").alias("salts")).where("salts > 1")
    hot = shared.written(hot, "hot")
    fit = F.broadcast if hot.count() <= BROADCAST_OWNERS else (lambda x: x)
    salts = F.coalesce("salts", F.lit(1))
    refs = cut.where("id = owner").select("owner", "id", "body").distinct().join(fit(hot), "owner", "left")
    refs = refs.select("owner", F.explode(F.sequence(F.lit(0), salts - 1)).alias("salt"), F.lit(False).alias("probe"), "id", F.lit(None).cast("long").alias("th"), F.lit(None).cast("int").alias("start"), "body")
    streamed = cut.where("id > owner").join(fit(hot), "owner", "left")
    streamed = streamed.select("owner", F.pmod(F.xxhash64("id", "th", "start"), salts).cast("int").alias("salt"), F.lit(True).alias("probe"), "id", "th", "start", "body")
    return refs.unionByName(streamed).repartition("owner", "salt").sortWithinPartitions("owner", "salt", "probe")


def spans(d: DataFrame, window: int = WINDOW, gram: int = GRAM, shard_words: int = SHARD_WORDS, probes: int = PROBES, piece: int = PIECE) -> DataFrame:
    """(id, th, spans) for rows (id, th, text): spans of words covered by windows that a smaller id has."""
    spark = d.sparkSession
    shared.tune(spark)
    kind = d.schema["id"].dataType.simpleString()
    keys = d.where("id is not null").select("id", "text").mapInArrow(lambda b: _anchors(b, window, gram, kind), f"key long, id {kind}")
    found, round_ = None, 0
    while True:
        owned = keys.groupBy("key").agg(F.min("id").alias("owner"), F.max("id").alias("top")).where("owner < top").select("key", "owner")
        marks = keys.join(owned, "key").groupBy("id").agg(F.collect_set(F.struct("key", "owner")).alias("m")).select("id", F.col("m.key").alias("keys"), F.col("m.owner").alias("owners"))
        at = round_
        cut = d.join(marks, "id").select("id", "th", "text", "keys", "owners").mapInArrow(lambda b, at=at: _passages(b, window, gram, at, piece), f"owner {kind}, id {kind}, th long, start int, body binary")
        cut = shared.written(cut, "passages")
        got = _dealt(cut, probes).mapInArrow(lambda b, at=at: _matched(b, window, gram, at + 1, shard_words), f"id {kind}, th long, spans array<struct<s:int,e:int>>, missed array<long>")
        got = shared.written(got, "matched")
        part = got.where("size(spans) > 0").select("id", "th", "spans")
        found = part if found is None else found.unionByName(part)
        keys = got.select("id", F.explode("missed").alias("key")).distinct()
        if round_ and keys.isEmpty():
            return found.groupBy("id", "th").agg(F.flatten(F.collect_list("spans")).alias("spans"))
        round_ += 1


def _kept(texts: pa.Array, spans_: pa.Array) -> list[pa.Array]:
    """Kept words joined by one space, number of words, number of removed words."""
    w = shared.Words(texts)
    m = len(w.starts)
    change = np.zeros(m + 1, np.int64)
    spans_ = spans_.combine_chunks() if isinstance(spans_, pa.ChunkedArray) else spans_
    flat = spans_.flatten()
    if len(flat):
        sizes = pa.compute.fill_null(pa.compute.list_value_length(spans_), 0).to_numpy(zero_copy_only=False)
        base = np.repeat(w.first[:-1], sizes)
        np.add.at(change, base + flat.field("s").to_numpy(), 1)
        np.add.at(change, base + flat.field("e").to_numpy(), -1)
    gone = np.cumsum(change)[:m] > 0
    stay = np.flatnonzero(~gone)
    followed = np.r_[w.row[stay][1:] == w.row[stay][:-1], False] if len(stay) else np.zeros(0, bool)
    size = len(w.data)
    delta = np.zeros(size + 1, np.int8)
    delta[w.starts[stay]] += 1
    delta[w.ends[stay]] -= 1
    mask = np.cumsum(delta[:size], dtype=np.int8).astype(bool)
    spaces = w.ends[stay][followed]
    mask[spaces] = True
    data = w.data.copy()
    data[spaces] = 32
    sums = np.zeros(size + 1, np.int64)
    np.cumsum(mask, out=sums[1:])
    off = sums[w.offsets].astype(np.int32)
    text = pa.StringArray.from_buffers(len(texts), pa.py_buffer(off.tobytes()), pa.py_buffer(data[mask].tobytes()))
    n = np.diff(w.first)
    left = np.bincount(w.row[stay], minlength=len(texts))
    return [text, pa.array(n), pa.array(n - left)]


def remove_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", window: int = WINDOW, gram: int = GRAM, shard_words: int = SHARD_WORDS, probes: int = PROBES, piece: int = PIECE) -> DataFrame:
    """docs with columns kept_, n_words_, n_removed_ (and spans_, the removed spans, not merged).

    kept_ has the words not removed, joined by one space. Words are runs of anything but white space (0x20,
    0x09-0x0D); a null or empty text has none. Rows keep their order of nothing and their number: repeated
    rows of an id count as one document, so they don't remove each other; a row with a null id neither loses
    words nor takes any from others. Texts under one id that differ are parts of one document. Other
    columns pass through; names that end in an underscore as above are replaced.
    """
    shared.tune(docs.sparkSession)
    d = docs.select(F.col(doc_id).alias("id"), F.xxhash64(F.col(text)).alias("th"), F.col(text).alias("text"))
    got = spans(d, window, gram, shard_words, probes, piece).select(F.col("id").alias("id_"), F.col("th").alias("th_"), F.col("spans").alias("spans_"))
    names = [c for c in docs.columns if c not in ("kept_", "n_words_", "n_removed_", "spans_")]
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("row_"), F.col(doc_id).alias("id"), F.xxhash64(F.col(text)).alias("th"))
    both = rows.join(got, (F.col("id") == F.col("id_")) & (F.col("th") == F.col("th_")), "left")
    both = both.select("row_", F.coalesce("spans_", F.array().cast("array<struct<s:int,e:int>>")).alias("spans_"))
    at = names.index(text)

    def run(batches):
        for b in batches:
            t = pa.compute.struct_field(b.column(0), [at])
            packed = pa.RecordBatch.from_arrays([b.column(0), b.column(1), t], ["row_", "spans_", "t"])
            for part, texts in shared.slices([packed], 2):
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), *_kept(texts, part.column(1))], ["row_", "spans_", "kept_", "n_words_", "n_removed_"])

    schema = both.selectExpr("row_", "spans_", "'' as kept_", "0L as n_words_", "0L as n_removed_").schema
    return both.mapInArrow(run, schema).select(*[F.col("row_").getField(c).alias(c) for c in names], "spans_", "kept_", "n_words_", "n_removed_")


def op1_substring_dedup(spark, sf_dir: str) -> DataFrame:
    """Per document its number of words, how many windows of 50 words that a smaller doc_id has cover, and the hash of the others; a null text has none."""
    docs = shared.read(spark, sf_dir, "documents").select("doc_id", "text")
    return remove_repeats(docs).select("doc_id", F.col("n_words_").alias("n_words"), F.col("n_removed_").alias("n_removed"), F.sha2(F.col("kept_").cast("binary"), 256).alias("kept_sha256"))


SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
win AS (SELECT doc_id, i, md5(array_to_string(list_slice(w, i, i + 49), ' ')) AS k FROM (SELECT doc_id, w, unnest(generate_series(1, len(w) - 49)) AS i FROM d WHERE len(w) >= 50)),
least AS (SELECT k, min(doc_id) AS m FROM win GROUP BY k HAVING min(doc_id) < max(doc_id)),
hit AS (SELECT DISTINCT doc_id, unnest(generate_series(i, i + 49)) AS p FROM win JOIN least USING (k) WHERE m < doc_id),
words AS (SELECT doc_id, unnest(generate_series(1, len(w))) AS p, unnest(w) AS word FROM d),
kept AS (SELECT doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY p) AS s FROM words ANTI JOIN hit USING (doc_id, p) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(s, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)
"""
