"""Token ids in a compressed file format with rank and select: one wavelet matrix per shard.

A shard holds some consecutive documents. Its ids are renumbered by their order among the
shard's distinct ids, and stored as bit-planes, highest bit first; below each
plane the tokens are ordered by a stable partition on its bit. Counts of ones before every
``BLOCK`` bits make rank a table look-up and a popcount, and select a binary search over ranks.

File layout (little-endian): magic ``TWWM0001``; unsigned 32-bit length and JSON header with the
counts and each section's length; then zstandard frames: document ids, null flags, token
counts, alphabet, and for every plane its bits and its rank table. Sections decompress by
themselves, so a reader touches what it needs.

Fixed results: a null text is the empty one (just the end id); a null document id is
flagged and sorts first; rows of one id are stored each by itself, ordered by a hash of the text, and may lie in several tasks' shards; an empty table gives no
shard; a text longer than a shard is a shard of its own; other columns are never read. Shards are rows of a table, as Spark's writers give no file names of one's own.
"""

from __future__ import annotations

import json
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_size, staged, texts_of
from .packing import partition_offsets
from .tokens import ENCODE_BYTES, encoder

MAGIC = b"TWWM0001"
BLOCK = 512
#: Tokens after which a shard is closed.
SHARD_TOKENS = 1 << 20


def _planes(ranks: np.ndarray, bits: int) -> Iterator[tuple[np.ndarray, int]]:
    """Each plane's packed bits and its number of zeros, highest bit first."""
    n, now, spare = len(ranks), ranks, np.empty_like(ranks)
    for b in range(bits - 1, -1, -1):
        one = (now & ranks.dtype.type(1 << b)) != 0
        zeros = n - int(np.count_nonzero(one))
        np.compress(~one, now, out=spare[:zeros])
        np.compress(one, now, out=spare[zeros:])
        yield np.packbits(one), zeros
        now, spare = spare, np.empty_like(ranks) if now is ranks else now


def build(doc_ids: list[int | None], sizes: np.ndarray, ids: np.ndarray) -> bytes:
    """The file of one shard. ``ids``: the documents' ids one after another."""
    alphabet = np.flatnonzero(np.bincount(ids, minlength=1)).astype("<u4") if len(ids) else np.zeros(0, "<u4")
    number = np.zeros(int(alphabet[-1]) + 1 if len(alphabet) else 1, np.uint16 if len(alphabet) <= 1 << 16 else np.uint32)
    number[alphabet] = np.arange(len(alphabet))
    bits = max(1, int(len(alphabet) - 1).bit_length())
    pack = zstandard.ZstdCompressor(level=1).compress
    null = np.array([d is None for d in doc_ids], bool)
    sections = [np.array([d or 0 for d in doc_ids], "<i8").tobytes(), np.packbits(null).tobytes(), sizes.astype("<u8").tobytes(), alphabet.tobytes()]
    zeros = []
    for plane, z in _planes(number[ids], bits):
        blocks = np.bitwise_count(np.pad(plane, (0, -len(plane) % (BLOCK // 8)))).reshape(-1, BLOCK // 8).sum(1, dtype=np.int64)
        sections += [plane.tobytes(), (np.cumsum(blocks) - blocks).astype("<u4").tobytes()]
        zeros.append(z)
    frames = [pack(s) for s in sections]
    head = json.dumps({"docs": len(doc_ids), "tokens": len(ids), "bits": bits, "zeros": zeros, "sections": [len(f) for f in frames]}).encode()
    return b"".join([MAGIC, struct.pack("<I", len(head)), head, *frames])


class Shard:
    """Reads a shard's file."""

    def __init__(self, data: bytes):
        if data[:8] != MAGIC:
            raise ValueError("not a token shard")
        (n,) = struct.unpack_from("<I", data, 8)
        head = json.loads(data[12 : 12 + n])
        self.n_docs, self.n_tokens, self.bits, self.zeros = head["docs"], head["tokens"], head["bits"], head["zeros"]
        at, self._frames = 12 + n, []
        for size in head["sections"]:
            self._frames.append(memoryview(data)[at : at + size])
            at += size
        null = np.unpackbits(np.frombuffer(self._section(1), np.uint8), count=self.n_docs)
        self.doc_ids = [None if x else int(d) for d, x in zip(np.frombuffer(self._section(0), "<i8"), null)]
        self.sizes = np.frombuffer(self._section(2), "<u8").astype(np.int64)
        self.alphabet = np.frombuffer(self._section(3), "<u4")
        self._held: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def _section(self, i: int) -> bytes:
        return zstandard.ZstdDecompressor().decompress(self._frames[i])

    def _plane(self, level: int) -> tuple[np.ndarray, np.ndarray]:
        if level not in self._held:
            self._held[level] = np.frombuffer(self._section(4 + 2 * level), np.uint8), np.frombuffer(self._section(5 + 2 * level), "<u4")
        return self._held[level]

    def _ones(self, level: int, i: int) -> int:
        """Ones among the first ``i`` bits of a plane."""
        plane, table = self._plane(level)
        block, rest = divmod(i, BLOCK)
        if block == len(table):
            block, rest = block - 1, BLOCK
        part = plane[block * (BLOCK // 8) : block * (BLOCK // 8) + (rest + 7) // 8]
        count = int(table[block]) + int(np.bitwise_count(part).sum())
        return count - (int(part[-1] & ((1 << (8 - rest % 8)) - 1)).bit_count() if rest % 8 and len(part) == (rest + 7) // 8 else 0)

    def _bit(self, level: int, i: int) -> int:
        return int(self._plane(level)[0][i >> 3] >> (7 - (i & 7))) & 1

    def access(self, i: int) -> int:
        """The id at position ``i``."""
        if not 0 <= i < self.n_tokens:
            raise IndexError(i)
        out = 0
        for level in range(self.bits):
            bit, ones = self._bit(level, i), self._ones(level, i)
            out = out << 1 | bit
            i = self.zeros[level] + ones if bit else i - ones
        return int(self.alphabet[out])

    def _number(self, token: int) -> int | None:
        i = int(np.searchsorted(self.alphabet, token))
        return i if i < len(self.alphabet) and self.alphabet[i] == token else None

    def _range(self, number: int, lo: int, hi: int) -> tuple[int, int]:
        for level in range(self.bits):
            a, b = self._ones(level, lo), self._ones(level, hi)
            lo, hi = (self.zeros[level] + a, self.zeros[level] + b) if number >> (self.bits - 1 - level) & 1 else (lo - a, hi - b)
        return lo, hi

    def count(self, token: int, lo: int = 0, hi: int | None = None) -> int:
        """Occurrences of an id among the positions from ``lo`` to before ``hi``."""
        number = self._number(token)
        if number is None:
            return 0
        a, b = self._range(number, lo, self.n_tokens if hi is None else hi)
        return b - a

    def select(self, token: int, k: int) -> int:
        """The position of an id's occurrence number ``k``, from 0."""
        number = self._number(token)
        a, b = (0, 0) if number is None else self._range(number, 0, self.n_tokens)
        if not 0 <= k < b - a:
            raise IndexError(k)
        i = a + k
        for level in range(self.bits - 1, -1, -1):
            one = number >> (self.bits - 1 - level) & 1
            wanted = i - self.zeros[level] if one else i
            lo, hi = 0, self.n_tokens
            while hi - lo > 1:  # the last place with so many of its kind before it
                mid = (lo + hi) // 2
                before = self._ones(level, mid)
                lo, hi = (mid, hi) if (before if one else mid - before) <= wanted else (lo, mid)
            i = lo
        return i

    def occurrences(self, token: int) -> list[int]:
        return [self.select(token, k) for k in range(self.count(token))]

    def decode(self) -> np.ndarray:
        """All ids in order, by undoing the partitions from the lowest plane up."""
        n = self.n_tokens
        now = np.zeros(n, np.uint16 if len(self.alphabet) <= 1 << 16 else np.uint32)
        for level in range(self.bits - 1, -1, -1):
            one = np.unpackbits(self._plane(level)[0], count=n).view(bool)
            zeros = self.zeros[level]
            now[zeros:] |= now.dtype.type(1 << (self.bits - 1 - level))
            above = np.empty_like(now)
            above[np.flatnonzero(~one)] = now[:zeros]
            above[np.flatnonzero(one)] = now[zeros:]
            now = above
            self._held.pop(level, None)
        return self.alphabet[now] if n else np.zeros(0, "<u4")


def write_shards(docs: DataFrame, path: str, end_id: int = 0, shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """``part, shard, before, n_docs, n_tokens, data``: the files of all shards in ascending ``doc_id`` order, written to
    the shared folder. ``before``: tokens of the part's shards before this one.
    """

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, enc = TaskContext.get().partitionId(), encoder(path)
        end = np.array([end_id], enc.dtype).tobytes()
        shard = before = held = 0
        names: list = []
        ids: list[bytes] = []

        def close() -> pa.RecordBatch:
            nonlocal shard, before, held
            sizes = np.array([len(x) // enc.width for x in ids], np.int64)
            data = build(names, sizes, np.frombuffer(b"".join(ids), enc.dtype))
            row = [part, shard, before, len(names), held, data]
            shard, before, held = shard + 1, before + held, 0
            names.clear()
            ids.clear()
            return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, (pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()))], names=["part", "shard", "before", "n_docs", "n_tokens", "data"])

        for batch in by_size(batches, ENCODE_BYTES):
            for key, x in zip(batch.column("doc_id").to_pylist(), enc.encode(texts_of(batch))):
                names.append(key)
                ids.append(x + end)
                held += len(ids[-1]) // enc.width
                if held >= shard_tokens:
                    yield close()
        if names:
            yield close()
        enc.rest()

    # The last column lets Spark cut even rows that are equal, so an id with very many rows is no single task's.
    place = ["doc_id", "__h", "__row"]
    ordered = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("__h"), F.monotonically_increasing_id().alias("__row")).repartitionByRange(*place).sortWithinPartitions(*place).select("doc_id", "text")
    return staged(ordered.mapInArrow(encode, "part int, shard int, before bigint, n_docs bigint, n_tokens bigint, data binary"), "shards")


def token_counts(shards: DataFrame, tokens: list[int]) -> DataFrame:
    """``token, n``: how often each id stands in all shards, by rank alone; a token that stands nowhere has 0."""
    tokens = list(dict.fromkeys(tokens))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in batch.column("data"):
                shard = Shard(data.as_buffer().to_pybytes())
                yield pa.RecordBatch.from_arrays([pa.array(tokens, pa.int64()), pa.array([shard.count(t) for t in tokens], pa.int64())], names=["token", "n"])

    found = shards.select("data").mapInArrow(each, "token bigint, n bigint")
    asked = shards.sparkSession.createDataFrame([(t, 0) for t in tokens], "token long, n long")
    return found.unionByName(asked).groupBy("token").agg(F.sum("n").alias("n"))


def token_places(shards: DataFrame, token: int) -> DataFrame:
    """``doc_id, place, start``: every occurrence of an id, by select: its place in the document, and in all ids of all documents."""
    base = partition_offsets(shards.groupBy("part").agg(F.sum("n_tokens")))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, before, data in zip(batch.column("part").to_pylist(), batch.column("before").to_pylist(), batch.column("data")):
                shard = Shard(data.as_buffer().to_pybytes())
                at = np.array(shard.occurrences(token), np.int64)
                ends = np.cumsum(shard.sizes)
                doc = np.searchsorted(ends, at, "right")
                yield pa.RecordBatch.from_arrays([pa.array([shard.doc_ids[d] for d in doc.tolist()], pa.int64()), pa.array(at - (ends - shard.sizes)[doc]), pa.array(at + base[part] + before)], names=["doc_id", "place", "start"])

    return shards.select("part", "before", "data").mapInArrow(each, "doc_id bigint, place bigint, start bigint")


def read_shards(shards: DataFrame) -> DataFrame:
    """A row for each document, from the files' bytes."""
    base = partition_offsets(shards.groupBy("part").agg(F.sum("n_tokens")))
    names = ["doc_id", "start", "n_tokens", "ids_crc32", "part", "shard"]

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                part, number, before = (batch.column(c)[i].as_py() for c in ("part", "shard", "before"))
                shard = Shard(batch.column("data")[i].as_buffer().to_pybytes())
                raw = memoryview(shard.decode()).cast("B") if shard.n_tokens else b""
                ends = np.cumsum(shard.sizes)
                starts = ends - shard.sizes
                crcs = [zlib.crc32(raw[4 * s : 4 * e]) for s, e in zip(starts.tolist(), ends.tolist())]
                n = shard.n_docs
                yield pa.RecordBatch.from_arrays([pa.array(shard.doc_ids, pa.int64()), pa.array(starts + base[part] + before), pa.array(shard.sizes), pa.array(crcs, pa.int64()), pa.array([part] * n, pa.int32()), pa.array([number] * n, pa.int32())], names=names)

    return shards.select("part", "shard", "before", "data").mapInArrow(decode, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint, part int, shard int")
