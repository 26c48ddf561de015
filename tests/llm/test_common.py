"""Staging, slices by size and guarded broadcasts."""

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tablewright.llm import common


def test_staged_tables_can_be_dropped(spark):
    df = common.staged(spark.range(3), "three")
    assert df.count() == 3 and common.staged(spark.range(0), "none").count() == 0
    common.drop_staged(spark)
    files = spark._jvm.org.apache.hadoop.fs.Path(common._staging(spark))
    assert not files.getFileSystem(spark._jsc.hadoopConfiguration()).exists(files)


def test_scratch_tables_go_and_kept_ones_stay(spark):
    there = lambda df: spark._jvm.org.apache.hadoop.fs.Path(df.staged_at).getFileSystem(spark._jsc.hadoopConfiguration()).exists(spark._jvm.org.apache.hadoop.fs.Path(df.staged_at))
    before = common.staged(spark.range(2), "before")
    with common.scratch(spark) as keep:
        outer = common.staged(spark.range(3), "outer")
        with common.scratch(spark) as keep_inner:
            gone, kept = common.staged(spark.range(1), "gone"), keep_inner(keep(common.staged(spark.range(0), "kept")))
        assert not there(gone) and there(kept) and there(outer)
    assert there(kept) and there(before) and not there(outer) and kept.count() == 0
    with pytest.raises(ZeroDivisionError), common.scratch(spark):
        stays = common.staged(spark.range(1), "stays")
        1 / 0
    assert there(stays) and not common._OPEN


def test_slices_keep_all_rows():
    texts = ["a" * n for n in (3, 0, 5, 50, 1, 1)] + [None, "é"]
    batch = pa.RecordBatch.from_arrays([pa.array(texts), pa.array(range(len(texts)))], names=["text", "i"])
    parts = list(common.by_size([batch, batch.slice(0, 0)], limit=9))
    assert [i for p in parts for i in p.column("i").to_pylist()] == list(range(len(texts)))
    assert all(sum(len(t.encode()) for t in common.texts_of(p)) <= 9 or p.num_rows == 1 for p in parts)


def test_broadcast_only_small(spark):
    plan = lambda df: df._jdf.queryExecution().logical().toString()
    rows = spark.createDataFrame([(1, "x" * 100, [1, 2, 3], ["yy"]), (None, None, None, None)], "a long, b string, c array<long>, d array<string>")
    held = common.held_bytes(rows)
    assert 200 < held < 600 and common.held_bytes(rows.limit(0)) == 0
    assert "broadcast" in plan(common.if_small(rows, held)).lower()
    assert "broadcast" not in plan(common.if_small(rows, held - 1)).lower()


def test_shared_folder(spark, tmp_path, monkeypatch):
    assert common.shared_dir(spark) == spark.conf.get("spark.checkpoint.dir")

    class Bare:
        """A session on a cluster without a shared folder, or with one given to its context."""

        def __init__(self, master, given=None):
            self.conf, self.sparkContext = self, self
            self.master, self.given, self.applicationId = master, given, "app-1"

        def get(self, key, default):
            return default

        def getCheckpointDir(self):
            return self.given

        def setCheckpointDir(self, path):
            self.given = path

    with pytest.raises(ValueError):
        common.shared_dir(Bare("spark://host:7077"))
    assert common.shared_dir(Bare("spark://host:7077", "hdfs://x/y")) == "hdfs://x/y"
    assert common.shared_dir(Bare("local[4]")).startswith("file://")


def test_once_is_not_copied(spark):
    df = spark.range(2).select(common.once(F.array("id", F.col("id") + 1)).alias("a")).where("size(a) > 1").select(F.explode("a").alias("x"))
    assert df._jdf.queryExecution().optimizedPlan().toString().count("SPARK_PARTITION_ID") <= 1 and df.count() == 4
