"""Byte-level BPE by overlapping chunks.

A text is cut into chunks that overlap. Chunks are pre-tokenised in parallel. The pattern never looks back, so
from the first pre-token boundary that two neighbouring chunks have in common, both go on alike: there
they are stitched. The piece of each chunk between its two stitches is then encoded on its own, again in
parallel, and the ids of a text are its pieces' ids in order. Texts of one chunk need no stitch and
are never shuffled. Decoding concatenates the raw bytes of the ids.
"""

from __future__ import annotations

import base64

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import shared

CHUNK, OVERLAP = 32_768, 1_024
#: Characters before a chunk's end in which a boundary may be owed to the end itself.
MARGIN = 4


def load(path: str | None = None) -> tuple[dict[bytes, int], str]:
    """Ranks of a vocabulary file (by default the public 50k byte-level one) and the pre-token pattern."""
    import public_tokenizers

    with open(path or public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}, public_tokenizers.PATTERN


def _encoding(shared_ranks):
    import tiktoken

    ranks, pattern = shared_ranks.value
    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def _lists(values: list) -> pa.Array:
    return pa.array(values, pa.list_(pa.int32()))


def boundaries(pattern, text: str) -> list[int]:
    """Where pre-tokens of text start."""
    return [m.start() for m in pattern.finditer(text)]


def encode(docs: DataFrame, text: str = "text", out: str = "ids", path: str | None = None, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """docs with a column of token ids (array<int>); a null or empty text has no ids.

    Every row is kept, repeated ones too; all other columns pass through, but one of the name out is
    replaced. A text in which two chunks find no common boundary (one pre-token longer than the overlap)
    is encoded in one piece. An empty table gives an empty one. The vocabulary (under a megabyte, whatever the data) is broadcast.
    """
    spark = docs.sparkSession
    shared.tune(spark)
    ranks = spark.sparkContext.broadcast(load(path))

    def whole():
        e = _encoding(ranks)
        return lambda texts: [_lists([e.encode_ordinary(t) for t in texts.to_pylist()])]

    size = F.coalesce(F.char_length(F.col(text)), F.lit(0))
    short = shared.extended(docs.where(size <= chunk), text, whole, f"{out} array<int>")
    names = docs.columns
    packed = docs.where(size > chunk).select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("row_"))
    long = shared.written(packed.withColumn("rid", F.monotonically_increasing_id()), "long")
    step = chunk - overlap

    def cut(batches):
        for b in batches:
            for rid, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                for k, at in enumerate(range(0, max(1, len(t) - overlap), step)):
                    yield pa.RecordBatch.from_pydict({"rid": [rid], "k": [k], "body": [t[at : at + chunk]], "last": [at + chunk >= len(t)]})

    chunks = long.select("rid", F.col("row_").getField(text).alias("t")).mapInArrow(cut, "rid long, k long, body string, last boolean")
    chunks = shared.written(chunks.repartition("rid", "k"), "chunks")

    def pretokenise(batches):
        import regex

        pattern = regex.compile(ranks.value[1])
        for b in batches:
            rows = {"rid": b.column(0).to_pylist(), "k": b.column(1).to_pylist(), "head": [], "tail": []}
            for k, t, last in zip(rows["k"], b.column(2).to_pylist(), b.column(3).to_pylist()):
                # not behind white space: where a piece ends with it, the pattern would see the end of the text
                found = [p for p in boundaries(pattern, t) if p and not t[p - 1].isspace()]
                rows["head"].append([k * step + p for p in found if p < overlap])
                rows["tail"].append([] if last else [k * step + p for p in found if step <= p < chunk - MARGIN])
            yield pa.RecordBatch.from_arrays([pa.array(rows["rid"], pa.int64()), pa.array(rows["k"], pa.int64()), pa.array(rows["head"], pa.list_(pa.int64())), pa.array(rows["tail"], pa.list_(pa.int64()))], ["rid", "k", "head", "tail"])

    ends = shared.written(chunks.mapInArrow(pretokenise, "rid long, k long, head array<long>, tail array<long>"), "ends")
    left = ends.select("rid", (F.col("k") + 1).alias("k"), F.col("tail").alias("before"))
    stitch = ends.where("k > 0").join(left, ["rid", "k"]).select("rid", "k", F.array_min(F.array_intersect("head", "before")).alias("at"))
    stitch = shared.written(stitch, "stitches")
    apart = stitch.where("at is null").select("rid").distinct()
    starts = stitch.select("rid", "k", F.col("at").alias("start"))
    stops = stitch.select("rid", (F.col("k") - 1).alias("k"), F.col("at").alias("stop"))
    parts = chunks.join(apart, "rid", "left_anti").join(starts, ["rid", "k"], "left").join(stops, ["rid", "k"], "left")
    origin = F.col("k") * step
    parts = parts.select("rid", "k", F.coalesce(F.col("start") - origin, F.lit(0)).alias("a"), F.coalesce(F.col("stop") - origin, F.lit(chunk)).alias("b"), "body")

    def pieces(batches):
        e = _encoding(ranks)
        for b in batches:
            rid, k, a, z, body = (c.to_pylist() for c in b.columns)
            yield pa.RecordBatch.from_arrays([pa.array(rid, pa.int64()), pa.array(k, pa.int64()), _lists([e.encode_ordinary(t[x:y]) for t, x, y in zip(body, a, z)])], ["rid", "k", "ids"])

    got = parts.mapInArrow(pieces, "rid long, k long, ids array<int>").groupBy("rid").agg(F.array_sort(F.collect_list(F.struct("k", "ids"))).alias("p"))
    got = got.select("rid", F.flatten(F.col("p.ids")).alias("ids_"))
    rest = [F.col("row_").getField(c).alias(c) for c in names if c != out]
    stitched = long.join(got, "rid").select(*rest, F.col("ids_").alias(out))
    single = shared.extended(long.join(apart, "rid").select(*[F.col("row_").getField(c).alias(c) for c in names]), text, whole, f"{out} array<int>")
    return short.unionByName(stitched).unionByName(single)


def decode(df: DataFrame, ids: str = "ids", out: str = "decoded", path: str | None = None) -> DataFrame:
    """df with a column of the raw bytes that the ids stand for; no ids, no bytes. A column of the name out is replaced."""
    ranks = df.sparkSession.sparkContext.broadcast(load(path))
    names = [c for c in df.columns if c != out]
    packed = df.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("row_"), F.coalesce(F.col(ids), F.array().cast("array<int>")).alias("ids_"))

    def run(batches):
        table = {i: b for b, i in ranks.value[0].items()}
        for b in batches:
            got = [b"".join(map(table.__getitem__, x)) for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(got, pa.binary())], ["row_", "out_"])

    schema = packed.select("row_").withColumn("out_", F.lit(b"")).schema
    return packed.mapInArrow(run, schema).select(*[F.col("row_").getField(c).alias(c) for c in names], F.col("out_").alias(out))


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of each document and the bytes that they decode to, as hashes; a null text is an empty one."""
    docs = shared.read(spark, sf_dir, "documents").select("doc_id", "text")
    coded = encode(docs).select("doc_id", "ids")
    return decode(coded).select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(" ", F.col("ids").cast("array<string>")).cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded"), 256).alias("decoded_sha256"),
    )
