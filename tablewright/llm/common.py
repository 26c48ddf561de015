"""Helpers shared by the training-data operators."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bytes of text that one vectorised step handles at a time (a longer text is handled alone).
GROUP_CHARS = 2_000_000
#: Bytes of text after which a worker gives back what it has freed.
TRIM_BYTES = 8_000_000


_OWN_DIRS: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: the session's ``spark.checkpoint.dir``, else the folder given to ``setCheckpointDir``.

    Only where neither is set and the master is local, as in tests, it is a temporary folder of this machine.
    """
    given = spark.sparkContext.getCheckpointDir()
    found = spark.conf.get("spark.checkpoint.dir", None) or given
    if not found:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        app = spark.sparkContext.applicationId
        found = _OWN_DIRS.setdefault(app, _OWN_DIRS.get(app) or "file://" + tempfile.mkdtemp(prefix="tablewright-"))
    if given is None:
        spark.sparkContext.setCheckpointDir(found)
    return found


def _staging(spark: SparkSession) -> str:
    return f"{shared_dir(spark).rstrip('/')}/tablewright/{spark.sparkContext.applicationId}"


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back.

    This cuts the lineage durably: lost executors re-read the table, and Python
    work above it is not repeated by each of its readers. ``drop_staged`` removes all of an application's.
    """
    spark = df.sparkSession
    path = f"{_staging(spark)}/{name}-{uuid.uuid4().hex}"
    for block in _OPEN:
        block.add(path)
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.staged_at = path
    return out


#: Paths staged in the ``scratch`` blocks that are open, innermost last. A driver thread stages at a time.
_OPEN: list[set[str]] = []


@contextmanager
def scratch(spark: SparkSession) -> Iterator[Callable[[DataFrame], DataFrame]]:
    """Tables staged in the block are deleted at its end, but for those given to the function that it yields: what these hold is stored, so nothing reads the others any more."""
    mine: set[str] = set()
    _OPEN.append(mine)

    def keep(df: DataFrame) -> DataFrame:
        mine.discard(df.staged_at)
        return df

    try:
        yield keep
    except BaseException:
        mine.clear()  # a failed job's tables stay for its next try
        raise
    finally:
        _OPEN.remove(mine)
        for path in mine:
            _delete(spark, path)


def _delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def drop_staged(spark: SparkSession) -> None:
    """Delete this application's staged tables. Call it once the results that read them are written."""
    _delete(spark, _staging(spark))


def trim() -> None:
    """Give memory that is free again back to the system; C's allocator keeps most of it otherwise, in idle workers too."""
    pa.default_memory_pool().release_unused()
    if (give_back := getattr(ctypes.CDLL(None), "malloc_trim", None)) is not None:
        give_back(0)


def by_size(batches: Iterator[pa.RecordBatch], limit: int = GROUP_CHARS, column: str = "text") -> Iterator[pa.RecordBatch]:
    """The batches in slices whose texts have ``limit`` bytes at most, a longer text by itself.

    Python objects are made of one slice at a time, so they take little memory however large Arrow's batches are. What they
    took is given back now and then, and at the end.
    """
    passed = 0
    for batch in batches:
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        start = 0
        while start < batch.num_rows:
            held = int(ends[start - 1]) if start else 0
            end = max(start + 1, int(np.searchsorted(ends, held + limit, "right")))
            yield batch.slice(start, end - start)
            passed += int(ends[end - 1]) - held
            if passed >= TRIM_BYTES:
                trim()
                passed = 0
            start = end
    trim()


def texts_of(batch: pa.RecordBatch, column: str = "text") -> list[str]:
    """The column's texts; a null text counts as the empty one."""
    return [t if t is not None else "" for t in batch.column(column).to_pylist()]


def slim(docs: DataFrame, *columns: str) -> DataFrame:
    """Only the named columns, so that further columns of any name cannot clash."""
    return docs.select(*(F.col(f"`{c}`") for c in columns))


def once(column: Column) -> Column:
    """``column``, computed once for each row.

    The optimizer copies an expression into each filter or lambda that uses its column, which makes work over arrays
    quadratic. It neither copies nor moves what depends on the partition at run time.
    """
    return F.when(F.spark_partition_id() >= 0, column)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


#: A side of a join is broadcast only if its bytes, summed over all its rows, are no more than this; else Spark shuffles both.
BROADCAST_BYTES = 16 << 20
#: What a row takes in a broadcast table besides its values.
_ROW_BYTES = 32


def held_bytes(df: DataFrame) -> int:
    """An upper estimate of a table's bytes in memory: one distributed sum, of which one row reaches the driver."""
    size = F.lit(_ROW_BYTES)
    for f in df.schema.fields:
        c, kind = F.col(f"`{f.name}`"), f.dataType
        if isinstance(kind, (T.StringType, T.BinaryType)):
            size = size + 16 + F.coalesce(F.octet_length(c), F.lit(0))
        elif isinstance(kind, T.ArrayType):
            size = size + 16 + 8 * F.greatest(F.coalesce(F.size(c), F.lit(0)), F.lit(0)) if not isinstance(kind.elementType, (T.StringType, T.BinaryType)) else size + 16 + F.coalesce(F.octet_length(F.to_json(c)), F.lit(0))
        else:
            size = size + 16
    return df.select(F.sum(size.cast("long"))).first()[0] or 0


def small(df: DataFrame, limit: int = BROADCAST_BYTES) -> bool:
    return held_bytes(df) <= limit


def if_small(df: DataFrame, limit: int = BROADCAST_BYTES) -> DataFrame:
    """``df`` with a broadcast hint if it is measured to be small, else with one that keeps Spark from guessing. Give a stored table."""
    return F.broadcast(df) if small(df, limit) else df.hint("merge")
