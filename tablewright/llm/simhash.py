"""Near-duplicate classes by 64-bit SimHash fingerprints and multi-index hashing.

Fingerprints are collapsed to distinct values first, so exact copies cost one row. Each of two 32-bit
segments of a fingerprint is looked up in a table of segment values: two fingerprints with at
most two differing bits agree in one segment up to one bit. So the ball of radius one around each segment is
enumerated (only flips from 0 to 1: of two values one bit apart, one flips up to the
other), table matches are fetched and complete distances verified.

A table entry with very many fingerprints (many near copies that differ in the
other segment only) is not paired with itself. Who looks it up enumerates the ball
of the remaining radius in the other segment instead and looks complete fingerprints
up: a fixed number of keys for each, and the same links.

Links are closed to components by label propagation with hooking and pointer jumping, on
tables only; the number of rounds grows with the logarithm of a component's size.

Fixed results: a null text is the empty one; texts without a word have fingerprint zero and are linked
like any other; a null id is no smallest id (a class of null ids only has component
null); repeated rows share their class; an empty table gives no row; other columns are never read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import by_size, if_small, scratch, slim, small, staged, texts_of

DISTANCE = 2
SHINGLE = 3
SEED = 42
#: Fingerprints of one table entry up to which they are fetched as they are.
ENTRY = 256
_HALF = 32
_MASK = (1 << _HALF) - 1
_BITS = [1 << i for i in range(_HALF)]


def fingerprint(text: str) -> int:
    """The fingerprint of a whole text: bits that are set in over half of its shingles' XXH64 values."""
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    n = max(1, len(words) - SHINGLE + 1)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[: n - 1] + 1])
    hashes = map(lambda a, b: xxhash.xxh64_intdigest(joined[a:b], SEED), starts.tolist(), ends[-n:].tolist())
    values = np.fromiter(hashes, np.uint64, n)
    counts = np.zeros(64, np.int64)
    for k in range(0, n, 1 << 16):
        bits = np.unpackbits(values[k : k + (1 << 16)].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(0, dtype=np.int64)
    return sum(1 << i for i in np.flatnonzero(2 * counts > n).tolist())


def fingerprints(docs: DataFrame) -> DataFrame:
    """``doc_id, h, fp``: the text's hash and the fingerprint as signed 64-bit numbers."""
    kind = dict(docs.dtypes)["doc_id"]

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_size(batches):
            fps = np.array([fingerprint(t) for t in texts_of(batch)], np.uint64).astype(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("h"), pa.array(fps)], names=["doc_id", "h", "fp"])

    return slim(docs, "doc_id", "text").withColumn("h", F.xxhash64("text")).mapInArrow(each, f"doc_id {kind}, h bigint, fp bigint")


def _segments(fp: str) -> str:
    return f"array(struct(0 AS s, shiftrightunsigned({fp}, {_HALF}) AS v), struct(1 AS s, {fp} & {_MASK}L AS v))"


def _longs(values: list[int]) -> str:
    return "array(" + ", ".join(f"{v}L" for v in values) + ")"


def links(points: DataFrame, entry: int = ENTRY) -> DataFrame:
    """``a, b``: every two distinct fingerprints ``fp`` of ``points`` with at most two differing bits, once, ``a`` and ``b`` in either order."""
    table = points.select(F.col("fp").alias("b"), F.explode(F.expr(_segments("fp"))).alias("t")).select("b", "t.s", F.col("t.v").alias("k"))
    ball = f"concat(array(struct(0 AS r, t.v AS k)), transform(filter({_longs(_BITS)}, p -> t.v & p = 0), p -> struct(1 AS r, t.v | p AS k)))"
    probes = points.select(F.col("fp").alias("a"), F.explode(F.expr(_segments("fp"))).alias("t")).select("a", "t.s", F.explode(F.expr(ball)).alias("c")).select("a", "s", "c.r", "c.k")
    full = staged(table.groupBy("s", "k").count().where(F.col("count") > entry).select("s", "k"), "full")
    near = (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= DISTANCE) & ((F.col("r") == 1) | (F.col("a") < F.col("b")))
    # Spark takes exploded rows for as many as their table's; the hint keeps it from broadcasting them.
    found = probes.join(table.join(full, ["s", "k"], "left_anti").hint("merge"), ["s", "k"]).where(near).select("a", "b")
    if not full.isEmpty():
        # Other segment of the wanted fingerprint: all values within the radius that is left.
        flips = [sum(c) for r in range(DISTANCE + 1) for c in combinations(_BITS, r)]
        near_flips = [sum(c) for r in range(DISTANCE) for c in combinations(_BITS, r)]
        crowded = probes.join(full, ["s", "k"], "left_semi")
        other = f"IF(s = 0, a & {_MASK}L, shiftrightunsigned(a, {_HALF}))"
        moved = crowded.select("a", "s", "r", "k", F.explode(F.expr(f"IF(r = 0, {_longs(flips)}, {_longs(near_flips)})")).alias("f"))
        wanted = moved.select("a", "r", F.expr(f"IF(s = 0, shiftleft(k, {_HALF}) | ({other} ^ f), shiftleft({other} ^ f, {_HALF}) | k)").alias("fp")).where((F.col("r") == 1) | (F.col("a") < F.col("fp")))
        found = found.unionByName(wanted.join(points.select("fp").hint("merge"), "fp").select("a", F.col("fp").alias("b")))
    return found.distinct()


def components(edges: DataFrame) -> DataFrame:
    """``u, root``: the smallest node of the component of every node that has a link (edges ``a, b``).

    Nodes are named by the roots that they hang on. A component with very many nodes would meet its root in one task, so what
    joins on roots is the table of distinct roots with their next ones, broadcast where it is small and else dealt out with salt.
    """
    both = staged(edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v"))), "edges")
    labels = staged(both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("root")), "roots")
    while True:
        ends = both.join(labels.select(F.col("u").alias("v"), F.col("root").alias("to")), "v").join(labels, "u")
        # A smaller neighbouring label reaches the node and the root that it hangs on.
        hooks = ends.where("to < root").select(F.explode(F.array("u", "root")).alias("u"), "to").groupBy("u").agg(F.min("to").alias("to"))
        hooked = staged(labels.join(hooks, "u", "left").select("u", F.least("root", "to").alias("root"), F.col("root").alias("was")), "hooked")
        heads = hooked.select("root").distinct()
        step = staged(heads.join(hooked.select(F.col("u").alias("root"), F.col("root").alias("next")), "root").where("next < root"), "next")
        jumped = _by_root(hooked, step).select("u", F.least("root", "next").alias("root"), (F.least("root", "next") < F.col("was")).alias("moved"))
        labels = staged(jumped, "roots")
        if labels.where("moved").isEmpty():
            return labels.select("u", "root")
        labels = labels.select("u", "root")


#: Shares that the nodes of one root are dealt to.
SALTS = 64


def _by_root(nodes: DataFrame, facts: DataFrame) -> DataFrame:
    """``nodes`` with what the stored table ``facts`` knows of their ``root``, one row for each root at most."""
    if small(facts):
        return nodes.join(F.broadcast(facts), "root", "left")
    dealt = facts.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return nodes.withColumn("salt", F.pmod(F.xxhash64("u"), F.lit(SALTS)).cast("int")).join(dealt.hint("merge"), ["root", "salt"], "left").drop("salt")


def _marks_and_classes(docs: DataFrame, entry: int) -> tuple[DataFrame, DataFrame]:
    """``doc_id, h, fp`` of every row, and ``fp, fp_class, component_id`` of every fingerprint."""
    with scratch(docs.sparkSession) as keep:
        marks = keep(staged(fingerprints(docs), "fingerprints"))
        points = staged(marks.groupBy("fp").agg(F.min("doc_id").alias("least")), "points")
        roots = staged(components(links(points.select("fp"), entry)).withColumnRenamed("u", "fp"), "linked")
        linked = staged(points.join(roots, "fp"), "linked-points")
        least = staged(linked.groupBy("root").agg(F.min("least").alias("component_id")), "least")
        named = linked.select("fp", "root").join(if_small(least), "root").select("fp", F.col("root").alias("__r"), F.col("component_id").alias("__c"))
        # Stored, so that both sides of the last join come from plain exchanges and Spark can split a fingerprint with very many documents.
        classes = points.join(named, "fp", "left").select("fp", F.coalesce("__r", "fp").alias("fp_class"), F.when(F.col("__r").isNull(), F.col("least")).otherwise(F.col("__c")).alias("component_id"))
        return marks, keep(staged(classes, "classes"))


def simhash_classes(docs: DataFrame, entry: int = ENTRY) -> DataFrame:
    """``doc_id, fingerprint, component_id`` of every document row."""
    marks, classes = _marks_and_classes(docs, entry)
    return marks.join(classes, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def one_of_each(docs: DataFrame, rows: DataFrame) -> DataFrame:
    """One document of each class, with its columns: the one with the smallest id, and of several texts under it the one with the smallest hash.

    ``rows`` are ``doc_id, h, class`` of every document, stored, ``h`` the ``xxhash64`` of its text. Rows equal in id and text are one document, of which one stays:
    the smallest in the other columns that have an order. Documents with a null id cannot be named and all stay. Texts are shuffled only where the
    dropped names are too many to broadcast.
    """
    named = rows.where("doc_id IS NOT NULL")
    first = staged(named.groupBy("class").agg(F.min(F.struct("doc_id", "h")).alias("first")).select("class", "first.*"), "first")
    counts = named.groupBy("class", "doc_id", "h").agg(F.count("*").alias("n"))
    # A class is spread over its rows' names before it meets its first row, so a large one is no single task's.
    firsts = first.select(F.col("class").alias("c"), F.col("doc_id").alias("first_id"), F.col("h").alias("first_h"))
    judged = staged(counts.join(if_small(firsts), F.col("class") == F.col("c")).select("doc_id", "h", "n", ((F.col("doc_id") == F.col("first_id")) & (F.col("h") == F.col("first_h"))).alias("stays")), "judged")
    key = [F.col("doc_id").alias("__id"), F.col("h").alias("__h")]
    at = (F.col("doc_id") == F.col("__id")) & (F.xxhash64("text") == F.col("__h"))
    out = docs.join(if_small(judged.where("NOT stays").select(*key)), at, "left_anti")
    again = judged.where("stays AND n > 1").select(*key)
    if again.isEmpty():
        return out
    again = if_small(again)
    ordered = F.struct(*(F.col(f"`{f.name}`") for f in docs.schema.fields if not isinstance(f.dataType, (T.MapType, T.ArrayType, T.StructType, T.VariantType))))
    repeated = docs.join(again, at).groupBy("__id", "__h").agg(F.min_by(F.struct(*(F.col(f"`{c}`") for c in docs.columns)), ordered).alias("__row"))
    return out.join(again, at, "left_anti").unionByName(repeated.select("__row.*"))


def simhash_dedup(docs: DataFrame) -> DataFrame:
    """One document of each class, as ``one_of_each`` gives it."""
    marks, classes = _marks_and_classes(docs, ENTRY)
    rows = staged(marks.join(classes, "fp").select("doc_id", "h", F.col("fp_class").alias("class")), "class-rows")
    return one_of_each(docs, rows)
