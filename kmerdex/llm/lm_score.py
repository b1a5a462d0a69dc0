"""Cross-entropy difference of two matched n-gram models, one of target texts and one of all texts.

Words are counted alone and in pairs over all documents, once for the target and once for the background. Both models
share one vocabulary, all words of all documents, whatever their number. The probability of a word after another mixes its
share of the pairs with its share of all words. A text's score is the mean over its words of loss under the target
model minus loss under the background; the text itself is left out of the counts that it is scored with.

No table of counts is gathered or stored. Documents are cut into pieces of about S bytes. A piece sends its sorted
distinct keys with their counts, cut by key range into P parts; a part adds up its keys over all pieces and answers each piece, in
the order in which the keys came, with the counts of all other pieces. S is the root of GRAIN times the bytes of
all texts (8 MB at least) and P their ratio, so that a piece's share of a part stays worth a row at any size: a task holds
about S bytes of text or the keys of as much, 8 MB up to 100 GB of text and 300 MB for 170 TB.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from . import shared
from .simhash import LOWER

#: Weight of pairs against single words.
MIX = 0.6
#: Bits of a key; the lowest tells pairs from words. Of 10 ** 13 keys, 2 in 10,000 share one with another.
KEY_BITS = 56
#: Bytes of text of a piece at least, and bytes whose keys make one row of a piece's share of a part worth while.
LEAST_PIECE, GRAIN = 1 << 23, 560
#: A text that is longer than so many average ones is a chunk of its own.
LONG = 64


def keys(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row and key of each word, and key of the pair that ends with it; 0, which is no pair's, for the first word of a text."""
    rows, ones, pairs = [], [], []
    for at, part in _numbered(texts):
        w = shared.Words(part)
        w.data = LOWER[w.data]
        h = w.hashes()
        pair = np.zeros(len(h), np.uint64)
        if len(h) > 1:
            pair[1:] = np.where(w.row[1:] == w.row[:-1], shared.mixed(shared.grams(h, 2), 5) >> np.uint64(64 - KEY_BITS) | np.uint64(1), np.uint64(0))
        rows.append(w.row + at)
        ones.append(shared.mixed(h, 3) >> np.uint64(64 - KEY_BITS) & ~np.uint64(1))
        pairs.append(pair)
    return (np.concatenate(rows), np.concatenate(ones), np.concatenate(pairs)) if rows else (np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.uint64))


def _numbered(texts: pa.Array):
    at = 0
    for _, part in shared.slices([pa.RecordBatch.from_arrays([texts], ["t"])], 0):
        yield at, part
        at += len(part)


def packed(values: np.ndarray) -> bytes:
    """Numbers as compressed planes of bytes, as many as the largest needs."""
    planes = max(1, (int(values.max()).bit_length() + 7) // 8) if len(values) else 1
    raw = values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :planes]
    return bytes([planes]) + pa.compress(np.ascontiguousarray(raw.T).tobytes(), codec="zstd", asbytes=True)


def unpacked(data: bytes, n: int) -> np.ndarray:
    planes = data[0]
    raw = np.frombuffer(pa.decompress(data[1:], decompressed_size=planes * n, codec="zstd", asbytes=True), np.uint8).reshape(planes, n)
    out = np.zeros((n, 8), np.uint8)
    out[:, :planes] = raw.T
    return out.view("<u8").reshape(-1)


class Piece:
    """Counts of a piece of texts, whose rows weigh (target, background): its sorted distinct keys, and (keys, 2) their own counts."""

    def __init__(self, texts: pa.Array, weight: np.ndarray):
        self.n, self.weight = len(texts), weight
        self.row, one, pair = keys(texts)
        self.paired = pair != 0
        both = np.concatenate([one, pair[self.paired]])
        self.key, place = np.unique(both, return_inverse=True)
        row = np.concatenate([self.row, self.row[self.paired]])
        self.own = np.stack([np.bincount(place, weights=weight[row, i], minlength=len(self.key)) for i in (0, 1)], 1).astype(np.int64)
        self.one, self.pair = place[: len(one)], place[len(one) :]
        # how often each word's and each pair's text has it itself
        _, back, count = np.unique(row * len(self.key) + place, return_inverse=True, return_counts=True)
        count = count[back]
        self.one_here, self.pair_here = count[: len(one)], count[len(one) :]

    def bounds(self, parts: int) -> np.ndarray:
        """Where each part's keys begin."""
        edge = np.array([(i << KEY_BITS) // parts for i in range(parts)], np.uint64)
        return np.append(np.searchsorted(self.key, edge), len(self.key))

    def losses(self, total: np.ndarray, words: np.ndarray, vocabulary: int) -> np.ndarray:
        """(words, 2) the loss of each word, in nats, under both models, without what its own text counted."""
        w = self.weight
        alone = total[self.one] - self.one_here[:, None] * w[self.row]
        size = words - np.bincount(self.row, minlength=self.n)[:, None] * w
        share = (alone + 1.0) / (size + vocabulary + 1)[self.row]
        at = np.flatnonzero(self.paired)
        both = total[self.pair] - self.pair_here[:, None] * w[self.row[at]]
        before = alone[at - 1]
        share[at] = np.where(before > 0, MIX * both / np.maximum(before, 1) + (1 - MIX) * share[at], share[at])
        return -np.log(share)


def _pieces(batches, size: int, lengths):
    """(rows, chunk): consecutive rows (chunk, seq, target, counted, ...) of one chunk, of up to about size bytes by the lengths of a batch's rows."""
    held, chunk, have = [], None, 0

    def joined(more):
        return pa.Table.from_batches([*held, *more]).combine_chunks().to_batches()[0]

    for b in batches:
        numbers, length = b.column(0).to_numpy(), lengths(b)
        lo = 0
        for i in range(b.num_rows):
            if (held or i > lo) and (numbers[i] != chunk or have >= size):
                yield joined([b.slice(lo, i - lo)] if i > lo else []), int(chunk)
                held, have, lo = [], 0, i
            chunk = numbers[i]
            have += int(length[i])
        if lo < b.num_rows:
            held.append(b.slice(lo))
    if held:
        yield joined([]), int(chunk)


def _weights(rows) -> np.ndarray:
    """(rows, 2) how often each row counts in the target and in the background."""
    target, counted = (rows.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("target", "counted"))
    return np.stack([target * counted, counted], 1)


def score(docs: DataFrame, target: Column, counted: Column | None = None, text: str = "text") -> DataFrame:
    """docs with n_tokens, target_loss, background_loss and difference (means over the words; null for texts without any).

    target tells the texts of the target model, counted (all by default) the texts that either model counts; each row is
    scored, by the counts of all rows but its own. Null conditions are false, null and empty texts have no words. Rows are kept,
    repeated ones too, which count for each other as any two rows do; an empty table gives an empty one. Other
    columns pass through, but the four names are replaced. A text of any length is scored whole. A key has one row per
    piece at most, so a frequent word is no more than the number of pieces.
    """
    spark = docs.sparkSession
    shared.tune(spark)
    new = ["n_tokens", "target_loss", "background_loss", "difference"]
    at = docs.columns.index(text)
    yes = [F.coalesce(c, F.lit(False)) for c in (target, F.lit(True) if counted is None else counted)]
    table = docs.select(
        F.monotonically_increasing_id().alias("seq"), F.coalesce(F.octet_length(F.col(text)), F.lit(0)).alias("bytes"),
        yes[0].alias("target"), yes[1].alias("counted"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row_"),
    )
    table = shared.written(table, "texts")
    n, size = table.agg(F.count("*"), F.coalesce(F.sum("bytes"), F.lit(0))).first()
    piece = max(LEAST_PIECE, int(math.sqrt(GRAIN * size)))
    parts = max(1, -(-size // piece))
    average = max(1, size // max(1, n))
    shift = max(0, int(math.log2(max(1, piece // average))))
    chunk = F.when(F.col("bytes") > LONG * average, -1 - F.col("seq")).otherwise(F.shiftright("seq", shift))
    chunked = table.select(chunk.alias("chunk"), "seq", "target", "counted", "row_")
    texts = F.coalesce(F.col("row_").getField(text), F.lit("")).alias("text")

    def send(batches):
        for rows, chunk in _pieces(batches, 2 * piece, lambda b: pc.binary_length(b.column(4)).to_numpy(zero_copy_only=False)):
            p = Piece(rows.column(4), _weights(rows))
            lo, hi = rows.column(1)[0].as_py(), rows.column(1)[-1].as_py()
            edge = p.bounds(parts)
            some = np.flatnonzero(np.diff(edge))
            cut = [(edge[k], edge[k + 1]) for k in some]
            step = np.diff(p.key, prepend=np.uint64(0))
            step[edge[some]] = p.key[edge[some]]  # each part's keys start from their first
            blobs = [[packed(x[a:z]) for a, z in cut] for x in (step, p.own[:, 0].astype(np.uint64), p.own[:, 1].astype(np.uint64))]
            m = len(cut)
            yield pa.RecordBatch.from_arrays(
                [pa.array(some), *(pa.array(np.full(m, x, np.int64)) for x in (chunk, lo, hi)), pa.array([z - a for a, z in cut], pa.int64()), *(pa.array(x, pa.binary()) for x in blobs)],
                ["part", "chunk", "lo", "hi", "n", "keys", "target", "background"],
            )

    def add(key, rows):
        count = rows.column("n").to_pylist()
        edge = np.r_[0, np.cumsum(count)]
        k = np.concatenate([np.cumsum(unpacked(x, m)) for x, m in zip(rows.column("keys").to_pylist(), count)])
        both = [np.concatenate([unpacked(x, m) for x, m in zip(rows.column(c).to_pylist(), count)]).astype(np.int64) for c in ("target", "background")]
        one, place = np.unique(k, return_inverse=True)
        sums = [np.bincount(place, weights=x, minlength=len(one)).astype(np.int64) for x in both]
        rest = [(s[place] - x).astype(np.uint64) for s, x in zip(sums, both)]
        blobs = [[packed(r[a:z]) for a, z in zip(edge[:-1], edge[1:])] for r in rest]
        word = one & np.uint64(1) == 0
        m = len(count)
        # the last row has the part's numbers of words: distinct, in the target, in all
        last = [int(word.sum()), *(int(s[word].sum()) for s in sums)]
        return pa.table({
            "chunk": pa.array([*rows.column("chunk").to_pylist(), None], pa.int64()), "lo": pa.array([*rows.column("lo").to_pylist(), None], pa.int64()),
            "hi": pa.array([*rows.column("hi").to_pylist(), None], pa.int64()), "part": pa.array([key[0].as_py()] * (m + 1), pa.int64()), "n": pa.array([*count, None], pa.int64()),
            "target": pa.array([*blobs[0], None], pa.binary()), "background": pa.array([*blobs[1], None], pa.binary()), "words": pa.array([None] * m + [last], pa.list_(pa.int64())),
        })

    sent = chunked.select("chunk", "seq", "target", "counted", texts).mapInArrow(send, "part long, chunk long, lo long, hi long, n long, keys binary, target binary, background binary")
    got = shared.written(sent.groupBy("part").applyInArrow(add, "chunk long, lo long, hi long, part long, n long, target binary, background binary, words array<long>"), "counts")
    sums = got.where("words is not null").agg(*[F.coalesce(F.sum(F.element_at("words", i)), F.lit(0)) for i in (1, 2, 3)]).first()
    vocabulary, words = sums[0], np.array(sums[1:], np.int64)

    def pack(batches):
        for rows, chunk in _pieces(batches, 2 * piece, lambda b: pc.fill_null(pc.binary_length(pc.struct_field(b.column(4), [at])), 0).to_numpy(zero_copy_only=False)):
            out = pa.BufferOutputStream()
            with pa.ipc.new_stream(out, rows.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as stream:
                stream.write_batch(rows)
            yield pa.RecordBatch.from_arrays([pa.array([chunk], pa.int64()), pa.array([out.getvalue().to_pybytes()], pa.binary())], ["chunk", "rows"])

    def judge(boxes, answers):
        rows = pa.concat_tables([pa.ipc.open_stream(x.as_py()).read_all() for x in boxes.column("rows")]).sort_by("seq")
        answers = answers.sort_by([("lo", "ascending"), ("part", "ascending")])
        seq = rows.column("seq").to_numpy()
        out = []
        lows = answers.column("lo").to_numpy()
        cut = np.flatnonzero(np.r_[True, lows[1:] != lows[:-1], True]) if len(lows) else np.zeros(1, np.int64)
        said = {int(lows[a]): (a, z) for a, z in zip(cut[:-1], cut[1:])}
        # rows of no piece with answers have no words
        edges = sorted({0, len(seq), *(int(np.searchsorted(seq, x)) for a, _ in said.values() for x in (lows[a], answers.column("hi")[int(a)].as_py() + 1))})
        for x, y in zip(edges[:-1], edges[1:]):
            part = rows.slice(x, y - x).combine_chunks().to_batches()[0]
            t = pc.fill_null(pc.struct_field(part.column("row_"), [at]), "")
            p = Piece(t, _weights(part))
            a, z = said.get(int(seq[x]), (0, 0))
            back = answers.slice(int(a), int(z - a))
            rest = [np.concatenate([unpacked(b, m) for b, m in zip(back.column(c).to_pylist(), back.column("n").to_pylist())] or [np.zeros(0, np.uint64)]) for c in ("target", "background")]
            if len(rest[0]) != len(p.key):
                raise RuntimeError("the answers of the counts do not fit the piece")
            loss = p.losses(np.stack(rest, 1).astype(np.int64) + p.own, words, vocabulary)
            m = np.bincount(p.row, minlength=p.n)
            means = [np.bincount(p.row, weights=loss[:, i], minlength=p.n) / np.maximum(m, 1) for i in (0, 1)]
            out.append(pa.RecordBatch.from_arrays([part.column("row_"), pa.array(m), *(pa.array(v, mask=m == 0) for v in (*means, means[0] - means[1]))], ["row_", *new]))
        return pa.Table.from_batches(out)

    schema = StructType([table.schema["row_"], *StructType.fromDDL("n_tokens long, target_loss double, background_loss double, difference double").fields])
    answers = got.where("words is null").select("chunk", "lo", "hi", "part", "n", "target", "background")
    boxes = chunked.mapInArrow(pack, "chunk long, rows binary")
    judged = boxes.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(judge, schema)
    kept = [F.col("row_").getField(c).alias(c) for c in docs.columns if c not in new]
    return judged.select(*kept, *new)


def op7_lm_score(spark, sf_dir: str) -> DataFrame:
    """Each document's mean losses under a model of English and one of all documents, and their difference; null losses for a null or empty text."""
    docs = shared.read(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return score(docs, F.col("lang") == "en").select("doc_id", "n_tokens", "target_loss", "background_loss", "difference")
