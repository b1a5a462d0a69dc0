"""SimHash near-duplicates by anchor-point covering.

Anchors are pairs of codewords of the perfect binary Golay code of length 23 over bits 0-22 and 23-45 of a
fingerprint: balls of radius three around its codewords tile the space, so every fingerprint lies within
the covering radius of exactly one codeword in each block. If two fingerprints differ in at most t bits, some
point between them is within t // 2 bits of one and the rest of the other; the anchor of that point lies
within covering radius plus share of the threshold of both. Each distinct fingerprint is therefore
replicated to all anchors that lie, block by block, within three bits plus, over both blocks, t - t // 2 more, and fingerprints
are compared on all 64 bits per anchor. Copies have one fingerprint and are replicated once. A crowded anchor is dealt
into parts of bounded size, and every two parts are a task's work of their own.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import shared

BITS = 3
SHINGLE = 3
LENGTH = 23
#: Fingerprints of one part of an anchor; crowded anchors whose numbers of parts are sent to every executor (beyond it they are joined).
CROWD, BROADCAST_ANCHORS = 1 << 16, 1_000_000
#: Generator polynomial of the Golay code.
GENERATOR = 0b110001110101

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def shingle_hashes(texts: pa.Array, n: int) -> tuple[np.ndarray, np.ndarray]:
    """XXH64 (seed 42) of each run of n words, A-Z lower-cased and space-joined, and where each text's begin; fewer words are one run."""
    from xxhash import xxh64_intdigest

    w = shared.Words(texts)
    word = np.zeros(len(w.data) + 1, bool)
    word[:-1] = ~shared.SPACES[w.data]
    keep = word[:-1].copy()
    keep[1:] |= word[:-2]  # one separator after each word
    plain = LOWER[w.data]
    plain[~word[:-1]] = 32
    place = np.cumsum(keep)
    buf = plain[keep].tobytes()
    count = np.diff(w.first)
    per = np.where(count >= n, count - n + 1, np.minimum(count, 1))
    begin = np.zeros(len(per) + 1, np.int64)
    np.cumsum(per, out=begin[1:])
    at = np.repeat(w.first[:-1], per) + np.arange(begin[-1]) - np.repeat(begin[:-1], per)
    to = np.minimum(at + n, np.repeat(w.first[1:], per)) - 1
    a, z = (place[w.starts[at]] - 1).tolist(), place[w.ends[to] - 1].tolist()
    return np.fromiter((xxh64_intdigest(buf[x:y], 42) for x, y in zip(a, z)), np.uint64, len(a)), begin


#: For a byte, a word that has each of its bits in a byte of its own.
LANES = np.array([sum(((x >> j) & 1) << (8 * j) for j in range(8)) for x in range(256)], np.uint64)


def majority(h: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """For each text, the word whose bits are those set in over half of its hashes; zero without any."""
    n = np.diff(begin)
    out = np.zeros(len(n), np.uint64)
    some = np.flatnonzero(n)
    if not len(some):
        return out
    blocks = -(-n[some] // 255)  # so many hashes at most that a byte can count them
    first = np.zeros(len(some) + 1, np.int64)
    np.cumsum(blocks, out=first[1:])
    at = np.repeat(begin[:-1][some], blocks) + 255 * (np.arange(first[-1]) - np.repeat(first[:-1], blocks))
    parts = h.view(np.uint8).reshape(-1, 8)
    for byte in range(8):
        sums = np.add.reduceat(LANES[parts[:, byte]], at).view(np.uint8).reshape(-1, 8).astype(np.int64)
        totals = np.add.reduceat(sums, first[:-1], axis=0)
        bits = (2 * totals > n[some, None]).astype(np.uint64)
        out[some] |= (bits << (np.arange(8, dtype=np.uint64) + np.uint64(8 * byte))).sum(axis=1, dtype=np.uint64)
    return out


def fingerprints(docs: DataFrame, text: str = "text", out: str = "fp", shingle: int = SHINGLE) -> DataFrame:
    """docs with a long column out: the fingerprint's 64 bits; zero for a null text or one without words. A column of that name is replaced."""
    shared.tune(docs.sparkSession)

    def make():
        return lambda texts: [pa.array(majority(*shingle_hashes(texts, shingle)).view(np.int64))]

    return shared.extended(docs, text, make, f"{out} long")


class Covering:
    """Codewords of the Golay code near a word, by its syndrome."""

    def __init__(self, most: int):
        def remainder(v: int) -> int:
            for i in range(LENGTH - 1, 10, -1):
                if v >> i & 1:
                    v ^= GENERATOR << (i - 11)
            return v

        one = [remainder(1 << i) for i in range(LENGTH)]
        self.bytes = [np.array([remainder(x << s) if x << s < 1 << LENGTH else 0 for x in range(256)], np.int64) for s in (0, 8, 16)]
        found: list[list[tuple[int, int]]] = [[] for _ in range(most + 1)]
        for weight in range(3 + most + 1):
            for places in itertools.combinations(range(LENGTH), weight):
                s = 0
                for i in places:
                    s ^= one[i]
                found[max(0, weight - 3)].append((s, sum(1 << i for i in places)))
        #: By bits beyond the covering radius: patterns in the order of their syndromes, and where each syndrome's begin.
        self.near = []
        for rows in found:
            a = np.array(sorted(rows), np.int64)
            self.near.append((a[:, 1], np.searchsorted(a[:, 0], np.arange(2049))))
        self.most = most

    def syndrome(self, v: np.ndarray) -> np.ndarray:
        return self.bytes[0][v & 255] ^ self.bytes[1][v >> 8 & 255] ^ self.bytes[2][v >> 16]

    def anchors(self, fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(index into fp, anchor) for all anchors within reach."""
        mask = (1 << LENGTH) - 1
        v = fp.astype(np.uint64)
        a, b = (v & np.uint64(mask)).astype(np.int64), (v >> np.uint64(LENGTH) & np.uint64(mask)).astype(np.int64)
        sa, sb = self.syndrome(a), self.syndrome(b)
        rows, anchors = [], []
        for da in range(self.most + 1):
            for db in range(self.most + 1 - da):
                (pa_, ia), (pb, ib) = self.near[da], self.near[db]
                na, nb = ia[sa + 1] - ia[sa], ib[sb + 1] - ib[sb]
                n = na * nb
                row = np.repeat(np.arange(len(v)), n)
                k = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
                ca = a[row] ^ pa_[ia[sa[row]] + k // nb[row]]
                cb = b[row] ^ pb[ib[sb[row]] + k % nb[row]]
                rows.append(row)
                anchors.append((ca >> 11) << 12 | cb >> 11)  # twelve places of a cyclic codeword tell all of it
        return np.concatenate(rows), np.concatenate(anchors)


def linked(anchor: np.ndarray, fp: np.ndarray, bits: int, block: int = 2048, second: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Spanning pairs (fingerprint, smallest one joined to it) among fingerprints of equal anchors (sorted) within bits.

    Where some fingerprints of an anchor are of a second side, it is enough to compare the sides with each other.
    """
    nodes, ix = np.unique(fp, return_inverse=True)
    cut = np.flatnonzero(np.r_[True, anchor[1:] != anchor[:-1]])
    size = np.diff(np.r_[cut, len(anchor)])
    big = size > 64
    a_, b_ = [], []
    small = np.repeat(~big, size)
    at, f, g = anchor[small], fp[small], ix[small]
    for k in range(1, 64):
        same = np.flatnonzero(at[k:] == at[:-k])
        if not len(same):
            break
        hit = same[np.bitwise_count(f[same] ^ f[same + k]) <= bits]
        a_.append(g[hit])
        b_.append(g[hit + k])
    label = shared.forest(len(nodes), np.concatenate(a_) if a_ else np.zeros(0, int), np.concatenate(b_) if b_ else np.zeros(0, int))
    for c, n in zip(cut[big], size[big]):
        f, g = fp[c : c + n], ix[c : c + n]
        far = second[c : c + n] if second is not None else np.zeros(n, bool)
        sides = far.any()
        (f, f2), (g, g2) = ((f[~far], f[far]), (g[~far], g[far])) if sides else ((f, f), (g, g))
        for i in range(0, len(f), block):
            for j in range(0 if sides else i, len(f2), block):
                x, y = np.nonzero(np.bitwise_count(f[i : i + block, None] ^ f2[None, j : j + block]) <= bits)
                p, q = label[g[i + x]], label[g2[j + y]]
                apart = p != q
                if apart.any():
                    label = shared.forest(len(nodes), p[apart], q[apart])[label]
    moved = np.flatnonzero(label != np.arange(len(nodes)))
    return nodes[moved], nodes[label[moved]]


def links(fps: DataFrame, bits: int = BITS, crowd: int = CROWD) -> DataFrame:
    """Pairs (a, b) of the distinct values of column fp that connect all those within bits of each other; as many as needed for the components, not all."""
    spark = fps.sparkSession
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "20000")

    def replicate(batches):
        code = Covering(bits - bits // 2)
        for b in batches:
            for at in range(0, b.num_rows, 4096):
                v = b.column(0).slice(at, 4096).to_numpy(zero_copy_only=False).view(np.uint64)
                row, anchor = code.anchors(v)
                yield pa.RecordBatch.from_arrays([pa.array(anchor.astype(np.int32)), pa.array(v[row].view(np.int64))], ["anchor", "fp"])

    def compare(batches):
        kept_a, kept_f, kept_s, n = [], [], [], 0

        def done(a, f, s):
            x, y = linked(a, f.view(np.uint64), bits, second=s)
            return pa.RecordBatch.from_arrays([pa.array(x.view(np.int64)), pa.array(y.view(np.int64))], ["a", "b"])

        for b in batches:
            kept_a.append(b.column(0).to_numpy())
            kept_f.append(b.column(1).to_numpy())
            kept_s.append(b.column(2).to_numpy(zero_copy_only=False))
            n += b.num_rows
            if n >= 1 << 18:
                a, f, s = np.concatenate(kept_a), np.concatenate(kept_f), np.concatenate(kept_s)
                whole = int(np.searchsorted(a, a[-1]))  # the last anchor may go on
                if whole:
                    yield done(a[:whole], f[:whole], s[:whole])
                    a, f, s = a[whole:], f[whole:], s[whole:]
                kept_a, kept_f, kept_s, n = [a], [f], [s], len(a)
        if n:
            yield done(np.concatenate(kept_a), np.concatenate(kept_f), np.concatenate(kept_s))

    # a task's fingerprints are few bytes that become many rows, so they are dealt to all tasks whatever their bytes
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    spread = fps.select("fp").repartition(tasks, "fp").distinct().mapInArrow(replicate, "anchor int, fp long")
    # fingerprints are replicated twice, once to find crowded anchors; only those are dealt into parts, by a hash
    crowded = shared.written(spread.groupBy("anchor").count().where(F.col("count") > crowd).select("anchor", F.ceil(F.col("count") / crowd).alias("parts")), "crowded")
    few = F.broadcast if crowded.limit(BROADCAST_ANCHORS + 1).count() <= BROADCAST_ANCHORS else (lambda x: x)
    dealt = spread.join(few(crowded), "anchor", "left").withColumn("parts", F.coalesce("parts", F.lit(1).cast("long")))
    dealt = dealt.withColumn("p", F.pmod(F.xxhash64("fp"), "parts")).withColumn("q", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
    # an anchor has 24 bits, a part 20
    cell = F.shiftleft(F.col("anchor").cast("long"), 40).bitwiseOR(F.shiftleft(F.least("p", "q"), 20)).bitwiseOR(F.greatest("p", "q"))
    dealt = dealt.select(cell.alias("cell"), "fp", (F.col("p") > F.col("q")).alias("second"))
    return dealt.repartition("cell").sortWithinPartitions("cell").mapInArrow(compare, "a long, b long").distinct()


def classes(fps: DataFrame, bits: int = BITS) -> DataFrame:
    """(doc_id, fp, component_id) for rows (doc_id, fp): the smallest doc_id reachable by links of at most bits differing bits.

    Null ids are reached but never named, unless a component has no other; repeated rows stay; an empty
    table gives an empty one.
    """
    first = shared.written(fps.groupBy("fp").agg(F.min("doc_id").alias("least")), "values")
    joined = shared.written(shared.components(shared.written(links(first, bits), "links")), "joined")
    of = first.join(joined, F.col("fp") == F.col("node"), "left").select("fp", "least", F.coalesce("component", "fp").alias("c"))
    least = of.groupBy("c").agg(F.min("least").alias("component_id"))
    return fps.join(of.join(least, "c").select("fp", "component_id"), "fp").select("doc_id", "fp", "component_id")


#: Bands of MinHash values by which texts are put into one cluster, and values of a band. Two sets of similarity s share a band with
#: probability 1 - (1 - s ** ROWS) ** BANDS, whatever the texts are: 1 - 3e-6 at 0.8.
BANDS, ROWS = 32, 5
#: Runs of words of one part of a cluster; parts are compared two by two.
PART = 1 << 18


def run_sets(texts: pa.Array, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashes of the runs of n words (A-Z lower-cased) of each text, sorted, and where each text's begin; fewer words are one run."""
    w = shared.Words(texts)
    w.data = LOWER[w.data]
    h = w.hashes()
    count = np.diff(w.first)
    g = shared.grams(h, n)
    at = np.flatnonzero(w.row[n - 1 :] == w.row[: len(g)]) if len(g) else np.zeros(0, np.int64)
    row, value = [w.row[at]], [g[at]]
    for k in range(1, n):
        few = np.flatnonzero(count == k)
        if len(few):
            row.append(few)
            value.append(shared.mixed(shared.grams(h, k)[w.first[few]], k))
    row, value = np.concatenate(row), np.concatenate(value)
    order = np.lexsort((value, row))
    row, value = row[order], value[order]
    new = np.r_[True, (row[1:] != row[:-1]) | (value[1:] != value[:-1])] if len(row) else np.zeros(0, bool)
    row, value = row[new], value[new]
    return value, np.searchsorted(row, np.arange(len(texts) + 1))


def bands(value: np.ndarray, begin: np.ndarray, n: int = BANDS, rows: int = ROWS) -> np.ndarray:
    """(texts, n) keys of the MinHash bands of sets; empty sets have keys of their own."""
    some = np.flatnonzero(np.diff(begin))
    out = np.zeros((len(begin) - 1, n), np.uint64)
    odd = np.random.default_rng(11).integers(1 << 63, size=n * rows, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    if len(some):
        for k in range(n):
            key = np.full(len(some), k, np.uint64)
            for m in odd[k * rows : (k + 1) * rows]:
                key = shared.mixed(key * np.uint64(31) + np.minimum.reduceat(value * m, begin[:-1][some]))
            out[some, k] = key
    return out


def signed(own: DataFrame, words: int) -> DataFrame:
    """(id, fp, keys): fingerprint and band keys of each text, made in one pass over the texts."""

    def signs(batches):
        for b in batches:
            for part, texts in shared.slices([b], 1):
                fp = majority(*shingle_hashes(texts, SHINGLE)).view(np.int64)
                k = bands(*run_sets(texts, words)).view(np.int64)
                keys = pa.ListArray.from_arrays(np.arange(0, k.size + 1, k.shape[1], dtype=np.int32), pa.array(k.reshape(-1)))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(fp), keys], ["id", "fp", "keys"])

    return own.select("doc_id", "text").mapInArrow(signs, "id long, fp long, keys array<long>")


def fingerprint_pairs(fps: DataFrame, bits: int = BITS) -> DataFrame:
    """(a, b): pairs of ids of rows (id, fp) that connect all those whose fingerprints differ in at most so many bits, found by their anchors."""
    spark = fps.sparkSession
    first = shared.written(fps.groupBy("fp").agg(F.min("id").alias("least")), "values")
    met = shared.written(links(first, bits), "met")
    shared.tune(spark)  # texts follow fingerprints
    equal = fps.join(first, "fp").select(F.col("id").alias("a"), F.col("least").alias("b"))
    a, b = first.select(F.col("fp").alias("a"), F.col("least").alias("x")), first.select(F.col("fp").alias("b"), F.col("least").alias("y"))
    return equal.unionByName(met.join(a, "a").join(b, "b").select(F.col("x").alias("a"), F.col("y").alias("b"))).where("a <> b")


def clusters(own: DataFrame, words: int) -> DataFrame:
    """(id, cluster): texts that SimHash links, or that share a band with another, directly or by way of others.

    Fingerprints are those of op6, linked through the same anchors; bands find the texts that are alike though their fingerprints are not.
    Bands are grouped by their smallest id, so no group is gathered.
    """
    signs = shared.written(signed(own, words), "signs")
    keyed = signs.select(F.explode("keys").alias("key"), "id")
    least = keyed.groupBy("key").agg(F.min("id").alias("b"), F.max("id").alias("z")).where("b < z").select("key", "b")
    pairs = keyed.join(least, "key").where("id <> b").select(F.col("id").alias("a"), "b").unionByName(fingerprint_pairs(signs.select("id", "fp")))
    return shared.components(pairs).select(F.col("node").alias("id"), F.col("component").alias("cluster"))


def alike(ids: np.ndarray, sets: list[np.ndarray], second: np.ndarray, whole: bool, similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (id, smallest id joined to it) that span what all pairs of sets with that Jaccard similarity connect; only pairs of one first and one second unless whole."""
    n = len(sets)
    size = np.array([len(x) for x in sets], np.int64)
    value = np.concatenate(sets) if n else np.zeros(0, np.uint64)
    of = np.repeat(np.arange(n), size)
    left, right = (np.ones(n, bool),) * 2 if whole else (~second, second)
    # postings of the second side, by value
    inside = right[of]
    post, doc = value[inside], of[inside]
    order = np.argsort(post, kind="stable")
    post, doc = post[order], doc[order]
    lo, hi = np.searchsorted(post, value), np.searchsorted(post, value, side="right")
    begin = np.r_[0, np.cumsum(size)]
    a, b = [], []
    for x in np.flatnonzero(left).tolist():
        f, t = lo[begin[x] : begin[x + 1]], hi[begin[x] : begin[x + 1]]
        k = t - f
        at = np.arange(k.sum()) + np.repeat(f - np.cumsum(k) + k, k)
        both = np.bincount(doc[at], minlength=n)
        y = np.flatnonzero(right & (both >= similarity * (size + size[x] - both) - 1e-12))
        a.append(np.full(len(y), x))
        b.append(y)
    if not a:
        return ids[:0], ids[:0]
    rank = np.argsort(np.argsort(ids))
    label = shared.forest(n, rank[np.concatenate(a)], rank[np.concatenate(b)])
    moved = np.flatnonzero(label[rank] != rank)
    return ids[moved], np.sort(ids)[label[rank[moved]]]


def near_pairs(own: DataFrame, words: int, similarity: float, part: int = PART) -> DataFrame:
    """(a, b): pairs of doc_ids that connect all texts of one cluster whose sets of runs of words have that similarity.

    Every pair of a cluster is compared. A cluster is cut into parts of about so many runs, and each two parts are a
    task's work of their own, so that work spreads however large a cluster is.
    """
    held = clusters(own, words)

    def collected(batches):
        for b in batches:
            for rows, texts in shared.slices([b], 2):
                value, begin = run_sets(texts, words)
                size = np.diff(begin)
                data = pa.Array.from_buffers(pa.large_binary(), len(size), [None, pa.py_buffer((begin * 8).astype(np.int64)), pa.py_buffer(value)])
                yield pa.RecordBatch.from_arrays([rows.column(0), rows.column(1), pa.array(size), data.cast(pa.binary())], ["cluster", "id", "n", "runs"])

    member = own.join(held.withColumnRenamed("id", "doc_id"), "doc_id").select("cluster", "doc_id", "text")
    sets = shared.written(member.mapInArrow(collected, "cluster long, id long, n long, runs binary"), "sets")
    parts = sets.groupBy("cluster").agg(F.ceil((F.sum("n") + 1) / F.lit(part)).cast("int").alias("parts"))
    own_part = F.pmod(F.xxhash64("id"), F.col("parts")).cast("int")
    dealt = sets.join(parts, "cluster").withColumn("p", own_part).withColumn("q", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    dealt = dealt.select("cluster", F.least("p", "q").alias("x"), F.greatest("p", "q").alias("y"), (F.col("p") > F.col("q")).alias("second"), "id", "runs")

    def compare(batches):
        now, ids, runs, second = None, [], [], []

        def done():
            if len(ids) < 2:
                return
            a, b = alike(np.array(ids, np.int64), [np.frombuffer(r, np.uint64) for r in runs], np.array(second), now[1] == now[2], similarity)
            if len(a):
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

        for batch in batches:
            for c, x, y, s, i, r in zip(*(k.to_pylist() for k in batch.columns)):
                if (c, x, y) != now:
                    yield from done()
                    now, ids, runs, second = (c, x, y), [], [], []
                ids.append(i)
                runs.append(r)
                second.append(s)
        yield from done()

    spread = dealt.repartition("cluster", "x", "y").sortWithinPartitions("cluster", "x", "y")
    return spread.mapInArrow(compare, "a long, b long")


def distinct(docs: DataFrame, words: int = 5, similarity: float = 0.8) -> DataFrame:
    """docs (columns doc_id, a long, and text) without copies and near-copies; of each group the smallest doc_id stays.

    Copies have the same text (by SHA-256). Near-copies have sets of runs of so many words (A-Z lower-cased, as
    64-bit hashes) with that Jaccard similarity; groups are what such pairs connect. SimHash links (fingerprints within
    BITS bits, by their anchors) and, for texts alike beyond that radius, MinHash bands over these sets put texts into clusters; inside a cluster all pairs are compared. Null and empty texts are copies
    of their like; rows with a null doc_id stay; of rows repeated under one doc_id all stay or none.
    """
    shared.tune(docs.sparkSession)
    keyed = docs.select("doc_id", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("sha")).where("doc_id is not null")
    first = shared.written(keyed.groupBy("sha").agg(F.min("doc_id").alias("doc_id")), "first").select("doc_id").distinct()
    own = docs.select("doc_id", "text").join(first, "doc_id", "left_semi")
    later = shared.components(near_pairs(own, words, similarity)).where("node > component").select(F.col("node").alias("doc_id"))
    stay = first.join(later, "doc_id", "left_anti").select(F.col("doc_id").alias("id_"))
    return docs.join(stay, F.col("doc_id") == F.col("id_"), "left_semi").unionByName(docs.where("doc_id is null"))


def op6_simhash(spark, sf_dir: str) -> DataFrame:
    """Fingerprint and component of each document; null and empty texts have the fingerprint zero and link with each other."""
    docs = shared.read(spark, sf_dir, "documents").select("doc_id", "text")
    fps = shared.written(fingerprints(docs).select("doc_id", "fp"), "fingerprints")
    return classes(fps).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
