"""Near copies by the Jaccard similarity of word shingles: SimHash fingerprints find candidates by multi-index hashing, the whole shingle sets decide.

A fingerprint's bit is the sign of the sum of its shingles' weights, a byte of a hash each. Two bits agree with a chance given by the angle between the sets, ``agreement`` at
the bound. At a similarity of 0.8 that is 0.84, so of 64 bits ten differ, and segments short enough for all of them would meet by chance. So fingerprints are as long as it takes: their
segments have a few bits more than the number of nodes has, and there are as many segments as keep the chance that a pair at the bound agrees in none at
``MISS`` or less. Fingerprints that agree in a segment are compared on ``BITS`` bits; at most ``radius`` may differ (a pair at the bound exceeds it with a chance of ``MISS`` at most too).

Texts of equal words are one node. Shingles that only one node has can be in no intersection: two sets can reach the
bound only if what either shares with any other text is large enough. So nodes with too many shingles of their own leave before fingerprints are made: first
by a fixed share of all shingles (Hoeffding's bound, again ``MISS``), then by all shingles of those that stay, exactly. In each segment's bucket all nodes are compared with one pivot first, the one with the least share of
own shingles (the text that the others were made from, if it is there); then only nodes that are not yet connected are compared with each other. So a
bucket of many near copies costs about its size, and no pair that could connect two components is left out.

Fixed results: a null text is the empty one; texts without words are copies of each other; a text shorter than a shingle is one
shingle; words are parted by ASCII blanks and compared without ASCII case; words, texts, nodes and shingles are told apart by 64-bit hashes;
a very long text is one row, whose shingles are hashed in memory in proportion to it; repeated rows, several texts under one id and null ids as in
``one_of_each``; an empty table gives no row; other columns pass.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import by_size, if_small, scratch, slim, staged, texts_of
from .simhash import SEED, components, one_of_each

SHINGLE = 5
SIMILARITY = 0.8
#: Bits of a segment at least, and by how many it has more than the number of nodes.
ROWS = 5
SPARE = 2
MISS = 1e-5
#: Bits on which fingerprints that meet are compared.
BITS = 128
#: By how much two bits of small sets (four and five shingles are the worst) agree less often than those of large ones.
SLACK = 0.01
#: One in so many shingles is counted first.
SHARE = 4
#: Shares that a text with very many partners is dealt to.
SALTS = 16
_MIX, _LANES = np.uint64(0x9E3779B97F4A7C15), np.uint64(0x00FF00FF00FF00FF)


def agreement(similarity: float) -> float:
    """The least chance that a bit is the same in two sets: what they share is at least ``2s / (1 + s)`` of the geometric mean of their sizes, the cosine of their angle."""
    return 1.0 if similarity >= 1 else 1 - math.acos(2 * similarity / (1 + similarity)) / math.pi - SLACK


def bands(similarity: float, rows: int = ROWS, miss: float = MISS) -> int:
    """Segments of ``rows`` places that it takes, if places agree with a chance of ``similarity`` each."""
    return 1 if similarity >= 1 else math.ceil(math.log(miss) / math.log1p(-(similarity**rows)))


def radius(similarity: float, bits: int = BITS, miss: float = MISS) -> int:
    """The differing bits of ``bits`` that a pair at the bound exceeds with a chance of ``miss`` at most."""
    q, over, r = 1 - agreement(similarity), 1.0, -1
    while over > miss and r < bits:
        r += 1
        over -= math.comb(bits, r) * q**r * (1 - q) ** (bits - r)
    return r


def _words(text: str) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").lower().split()


def _node(words: list[bytes]) -> int:
    return xxhash.xxh64_intdigest(b" ".join(words), SEED)


def shingles(words: list[bytes], width: int) -> np.ndarray:
    """The distinct hashes of all runs of ``width`` words."""
    if not words:
        return np.zeros(0, np.uint64)
    each = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
    n = max(1, len(words) - width + 1)
    out = np.zeros(n, np.uint64)
    for j in range(min(width, len(words))):
        out = (out ^ each[j : j + n]) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    return np.unique(out)


def similar(a: np.ndarray, b: np.ndarray, similarity: float) -> bool:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both + 1e-9 >= similarity * (len(a) + len(b) - both)


def fingerprint(values: np.ndarray, factors: np.ndarray) -> np.ndarray:
    """Eight bits for each of ``factors``, over all of a text's shingles: whether the sum of their weights, bytes less 127.5, is positive."""
    sums = np.zeros((2, 4 * len(factors)), np.int64)
    for k in range(0, len(values), 256):  # as many bytes as 16 bits can sum
        x = values[k : k + 256, None] * factors
        x ^= x >> np.uint64(32)
        x *= _MIX
        x ^= x >> np.uint64(32)
        for i in range(2):
            sums[i] += ((x >> np.uint64(8 * i)) & _LANES).sum(0).view(np.uint16)
    return 2 * sums.ravel() > 255 * len(values)


def named(docs: DataFrame, width: int = SHINGLE) -> DataFrame:
    """``doc_id, h, node, some``: the text's hash, its node and a share of its shingles, chosen by their hashes."""
    kind = dict(docs.dtypes)["doc_id"]

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_size(batches):
            nodes, some = [], []
            for text in texts_of(batch):
                words = _words(text)
                nodes.append(_node(words))
                found = shingles(words, width)
                some.append(found[found % np.uint64(SHARE) == 0].astype(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("h"), pa.array(np.array(nodes, np.uint64).astype(np.int64)), pa.array(some, pa.list_(pa.int64()))], names=["doc_id", "h", "node", "some"])

    return slim(docs, "doc_id", "text").withColumn("h", F.xxhash64("text")).mapInArrow(each, f"doc_id {kind}, h bigint, node bigint, some array<bigint>")


def _own(sets: DataFrame, column: str) -> DataFrame:
    """``node, own``: how many of a node's shingles in ``column`` no other node has."""
    each = sets.select("node", F.explode(column).alias("s")).groupBy("s").agg(F.min("node").alias("node"), F.max("node").alias("last"))
    return each.where("node = last").groupBy("node").agg(F.count("*").alias("own"))


def _texts(docs: DataFrame, marks: DataFrame, similarity: float) -> DataFrame:
    """``node, text``: one text of each node that shares enough of its counted shingles with others to have a similar one."""
    nodes = marks.groupBy("node").agg(F.min("h").alias("h"), F.first(F.size("some")).alias("m"))
    least = F.lit(similarity) * F.col("m") - F.sqrt(F.col("m") * F.lit(-math.log(MISS) / 2)) - 1e-6
    able = staged(nodes.join(_own(marks, "some"), "node", "left").where(F.col("m") - F.coalesce("own", F.lit(0)) >= least).select("node", "h"), "able-nodes")
    return slim(docs, "text").withColumn("h", F.xxhash64("text")).join(if_small(able), "h").dropDuplicates(["node"]).select("node", "text")


def fingerprints(texts: DataFrame, sizes: DataFrame, similarity: float = SIMILARITY, width: int = SHINGLE) -> DataFrame:
    """``node, size, held, f0, f1, keys``: the nodes of ``sizes``, stored, with the bits of their fingerprints to compare and the values of all its segments."""
    rows = max(ROWS, sizes.count().bit_length() + SPARE)
    segments = bands(agreement(similarity), rows)
    first, places = np.arange(segments, dtype=np.int64) << rows, np.int64(1) << np.arange(rows, dtype=np.int64)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        factors = np.random.default_rng(SEED).integers(0, 1 << 64, -(-max(BITS, segments * rows) // 8), np.uint64, endpoint=False) | np.uint64(1)
        for batch in by_size(batches):
            compared, keys = [], []
            for text in texts_of(batch):
                bits = fingerprint(shingles(_words(text), width), factors)
                compared.append(np.packbits(bits[:BITS]).view(np.int64))
                keys.append(bits[: segments * rows].reshape(segments, rows) @ places + first)
            both = np.array(compared, np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("node", "size", "held")), pa.array(both[:, 0]), pa.array(both[:, 1]), pa.array(keys, pa.list_(pa.int64()))], names=["node", "size", "held", "f0", "f1", "keys"])

    return texts.join(if_small(sizes), "node").select("node", "size", "held", "text").mapInArrow(each, "node bigint, size bigint, held bigint, f0 bigint, f1 bigint, keys array<bigint>")


def _with_text(pairs: DataFrame, texts: DataFrame, end: str, other: str) -> DataFrame:
    """``pairs`` with the text of ``end``, which is copied for shares of the other ends, so that one with very many pairs is no single task's."""
    dealt = pairs.withColumn("salt", F.pmod(F.xxhash64(other), F.lit(SALTS)))
    copies = dealt.select(end, "salt").distinct().join(texts.select(F.col("node").alias(end), F.col("text").alias(f"text_{end}")), end)
    return dealt.join(copies, [end, "salt"]).drop("salt")


def verified(pairs: DataFrame, texts: DataFrame, width: int, similarity: float) -> DataFrame:
    """The ``pairs`` ``a, b`` whose whole shingle sets are ``similar``."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_size(batches, column="text_a"):
            a, b = (texts_of(batch, c) for c in ("text_a", "text_b"))
            good = [similar(shingles(_words(x), width), shingles(_words(y), width), similarity) for x, y in zip(a, b)]
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], names=["a", "b"]).filter(pa.array(good, pa.bool_()))

    full = _with_text(_with_text(pairs, texts, "a", "b"), texts, "b", "a")
    return full.select("a", "b", "text_a", "text_b").mapInArrow(each, "a bigint, b bigint")


def _shared_sizes(texts: DataFrame, width: int) -> DataFrame:
    """``node, size, held``: a candidate's number of shingles, and of those that another candidate has too."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_size(batches):
            sets = [shingles(_words(t), width).astype(np.int64) for t in texts_of(batch)]
            yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array([len(s) for s in sets], pa.int64()), pa.array(sets, pa.list_(pa.int64()))], names=["node", "size", "shingles"])

    sets = staged(texts.mapInArrow(each, "node bigint, size bigint, shingles array<bigint>"), "shingle-sets")
    return staged(sets.select("node", "size").join(_own(sets, "shingles"), "node", "left").select("node", "size", (F.col("size") - F.coalesce("own", F.lit(0))).alias("held")), "shared-sizes")


def near_links(docs: DataFrame, marks: DataFrame, width: int = SHINGLE, similarity: float = SIMILARITY) -> DataFrame:
    """``a, b``: links of similar nodes that connect all nodes that similar pairs connect. ``marks`` are as ``named`` gives them, stored."""
    # Both sets of a pair at the bound share ``part`` of their sizes' sum; a node whose smallest possible partner asks for more than it holds has none.
    part = similarity / (1 + similarity) - 1e-9
    texts = staged(_texts(docs, marks, similarity), "candidate-texts")
    sizes = staged(_shared_sizes(texts, width).where(F.col("size") > 0).where(F.col("held") >= part * (1 + similarity) * F.col("size") - 1e-6), "sizes")
    points = staged(fingerprints(texts, sizes, similarity, width), "fingerprints")
    apart = radius(similarity)

    def near(x: str, y: str) -> Column:
        far = F.bit_count(F.col(f"{x}.f0").bitwiseXOR(F.col(f"{y}.f0"))) + F.bit_count(F.col(f"{x}.f1").bitwiseXOR(F.col(f"{y}.f1")))
        return (F.least(f"{x}.held", f"{y}.held") >= part * (F.col(f"{x}.size") + F.col(f"{y}.size"))) & (far <= apart)

    ends = [F.least("x.node", "y.node").alias("a"), F.greatest("x.node", "y.node").alias("b")]
    # What joins on a segment's value is stored, so both sides are plain exchanges and Spark can split a value with very many nodes.
    entries = points.select(F.explode("keys").alias("key"), F.struct("node", "size", "held", "f0", "f1").alias("x"))
    buckets = staged(entries.groupBy("key").agg(F.min("x.size").alias("least"), F.count("*").alias("n")).where("n > 1").select("key", "least"), "buckets")
    able = staged(entries.join(buckets.hint("merge"), "key").where(F.col("x.held") >= part * (F.col("x.size") + F.col("least"))).select("key", "x"), "able")
    rank = F.struct(F.col("x.held") / F.col("x.size"), F.xxhash64("x.node", "key"), "x")
    pivots = staged(able.groupBy("key").agg(F.max(rank).alias("p"), F.count("*").alias("n")).where("n > 1").select("key", F.col("p.x").alias("y")), "pivots")
    shared = staged(able.join(pivots.hint("merge"), "key"), "shared")
    star = staged(shared.where("x.node <> y.node").where(near("x", "y")).select(*ends).distinct(), "stars")
    links = staged(verified(star, texts, width, similarity), "star-links")
    roots = staged(components(links).withColumnRenamed("u", "node"), "star-roots")
    placed = staged(shared.select("key", "x", F.col("x.node").alias("node")).join(if_small(roots), "node", "left").select("key", "x", F.coalesce("root", "node").alias("root")), "placed")
    mixed = staged(placed.groupBy("key").agg(F.mode("root").alias("main"), F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo < hi").select("key", "main"), "mixed")
    inside = staged(placed.join(mixed.hint("merge"), "key"), "inside")
    odd = inside.where("root <> main").select("key", "x", F.col("root").alias("rx"))
    other = inside.select("key", F.col("x").alias("y"), F.col("root").alias("ry"), "main")
    left = odd.join(other.hint("merge"), "key").where("rx <> ry AND (ry = main OR x.node < y.node)").where(near("x", "y"))
    rest = left.select(*ends).distinct().join(star, ["a", "b"], "left_anti")
    return links.unionByName(verified(staged(rest, "rest"), texts, width, similarity))


def near_dedup(docs: DataFrame, width: int = SHINGLE, similarity: float = SIMILARITY) -> DataFrame:
    """One document of each class of near copies, with its columns, as ``one_of_each`` gives it."""
    with scratch(docs.sparkSession) as keep:
        marks = staged(named(docs, width), "named")
        roots = staged(components(near_links(docs, marks, width, similarity)).withColumnRenamed("u", "node"), "node-roots")
        rows = marks.select("doc_id", "h", "node").join(if_small(roots), "node", "left").select("doc_id", "h", F.coalesce("root", "node").alias("class"))
        rows = keep(staged(rows, "class-rows"))
    return one_of_each(docs, rows)
