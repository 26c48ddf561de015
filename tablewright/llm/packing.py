"""Packing token ids into fixed windows by concatenating and cutting.

First pass: every document's ids are written once, with its place inside its
partition. The partitions' token totals then give, by prefix sums, a global
offset for each of them. Second pass: windows of a fixed length cut the one
stream that these offsets define. A document that meets a window's end leaves a
piece on either side, and boundary flags say so. Only the last window is short.

Fixed results: a null text is the empty one (just the end id); a null id stays
null; repeated rows are packed each by itself; an empty table gives no piece;
other columns are never read. The order of the stream is the order of the input's partitions, so no
text is shuffled.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_size, slim, staged, texts_of
from .tokens import ENCODE_BYTES, encoder

WINDOW = 2048


def encode_partitions(docs: DataFrame, path: str, end_id: int) -> DataFrame:
    """``part, doc_id, place, n_tokens, ids``: each document's ids, and how many ids of its partition stand before it."""
    kind = dict(docs.dtypes)["doc_id"]

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, place, enc = TaskContext.get().partitionId(), 0, encoder(path)
        end = np.array([end_id], enc.dtype).tobytes()
        for batch in by_size(batches, ENCODE_BYTES):
            ids = [x + end for x in enc.encode(texts_of(batch))]
            sizes = np.array([len(x) // enc.width for x in ids], np.int64)
            places = place + np.cumsum(sizes) - sizes
            place += int(sizes.sum())
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(ids), part, np.int32)), batch.column("doc_id"), pa.array(places), pa.array(sizes), pa.array(ids, pa.binary())], names=["part", "doc_id", "place", "n_tokens", "ids"])
        enc.rest()

    return slim(docs, "doc_id", "text").mapInArrow(encode, f"part int, doc_id {kind}, place bigint, n_tokens bigint, ids binary")


def partition_offsets(totals: DataFrame) -> dict[int, int]:
    """part -> tokens in all partitions before it. ``totals`` has a row for each partition, as many as the scan has tasks."""
    at, out = 0, {}
    for part, n in sorted((r[0], r[1]) for r in totals.collect()):
        out[part] = at
        at += n
    return out


def pack(docs: DataFrame, path: str, end_id: int = 1, window: int = WINDOW) -> DataFrame:
    """The pieces of every document: where each starts in it, how long it is, and where it stands in its sequence."""
    kind = dict(docs.dtypes)["doc_id"]
    table = staged(encode_partitions(docs, path, end_id), "packed")
    base = partition_offsets(table.groupBy("part").agg(F.sum("n_tokens")))
    dtype = encoder(path).dtype
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "cut_before", "cut_after"]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            docs_, parts, places, sizes = (batch.column(c) for c in ("doc_id", "part", "place", "n_tokens"))
            first = np.array([base[p] for p in parts.to_pylist()], np.int64) + places.to_numpy()
            size = sizes.to_numpy()
            pieces = (first + size - 1) // window - first // window + 1
            row = np.repeat(np.arange(len(size)), pieces)
            nth = np.arange(len(row)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
            sequence = first[row] // window + nth
            begin = np.maximum(first[row], sequence * window)
            end = np.minimum(first[row] + size[row], (sequence + 1) * window)
            start, length = begin - first[row], end - begin
            held = batch.column("ids")
            crcs, at, wide = np.empty(len(row), np.int64), -1, None
            for i, (r, s, n) in enumerate(zip(row.tolist(), start.tolist(), length.tolist())):
                if r != at:
                    at, wide = r, memoryview(np.frombuffer(held[r].as_buffer(), dtype).astype("<u4")).cast("B")
                crcs[i] = zlib.crc32(wide[4 * s : 4 * (s + n)])
            columns = [docs_.take(pa.array(row)), start, length, crcs, size[row], sequence, begin - sequence * window, start > 0, start + length < size[row]]
            yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in columns], names=names)

    rows = table.select("part", "doc_id", "place", "n_tokens", "ids")
    return rows.mapInArrow(cut, f"doc_id {kind}, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint, cut_before boolean, cut_after boolean")
