"""Coverage over a stream of detections, and the stream of progress events."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState

from ..operators import coverage


#: What a batch adds to the counts: entities seen at all, seen once and twice, and the occasions that it names.
DELTAS = "batch long, ds long, d1 long, d2 long, occasions array<string>"


def _steps(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """An entity's state is its occasions. What comes out is how its arrival moves the counts."""
    seen = set(state.get[0]) if state.exists else set()
    before, here = len(seen), set()
    for rows in batches:
        here.update(rows["occasion"])
    seen |= here
    state.update((sorted(seen),))
    after = len(seen)
    yield pd.DataFrame({"ds": [int(after > 0) - int(before > 0)], "d1": [int(after == 1) - int(before == 1)], "d2": [int(after == 2) - int(before == 2)], "occasions": [sorted(here)]})


def running_estimate(deltas: DataFrame) -> DataFrame:
    """The estimate from the table of deltas, which has a row for each batch."""
    sums = deltas.agg(*(F.coalesce(F.sum(d), F.lit(0)).alias(n) for d, n in (("ds", "s_obs"), ("d1", "q1"), ("d2", "q2"))), F.size(F.array_distinct(F.flatten(F.collect_list("occasions")))).cast("long").alias("t"))
    return sums.withColumn("s_hat", coverage.chao2(*(F.col(c) for c in ("s_obs", "q1", "q2", "t"))))


def watch_coverage(detections: DataFrame, table: str, on_estimate: Callable[[int, DataFrame], bool], checkpoint: str):
    """Starts a query that keeps each entity's occasions as state and hands the estimate so far to the callback after each micro-batch of ``entity, occasion``.

    A batch costs time in proportion to its own rows: it moves the counts, and its move is one row of the Parquet table. The callback ends the query by
    returning true. A replayed batch overwrites its own row.
    """
    held: list = []

    def step(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        sums = batch.agg(*(F.coalesce(F.sum(d), F.lit(0)).alias(d) for d in ("ds", "d1", "d2")), F.array_distinct(F.flatten(F.collect_set("occasions"))).alias("occasions"))
        sums.select(F.lit(number).cast("long").alias("batch"), "*").coalesce(1).write.mode("overwrite").parquet(f"{table}/at={number}")
        if on_estimate(number, running_estimate(spark.read.schema(DELTAS).parquet(table))) and held:
            held[0].stop()

    rows = detections.select("entity", F.col("occasion").cast("string").alias("occasion")).where("entity IS NOT NULL AND occasion IS NOT NULL")
    moved = rows.groupBy("entity").applyInPandasWithState(_steps, "ds long, d1 long, d2 long, occasions array<string>", "occasions array<string>", "update", "NoTimeout")
    query = moved.writeStream.outputMode("update").foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    held.append(query)
    return query


def event_stream(spark: SparkSession, path: str, schema: str, files_per_batch: int = 1) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def windowed_counts(events: DataFrame, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Events by type in tumbling windows; late ones within the watermark still count."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("window.start").alias("start"), "event_type", "n", "total")


def session_counts(events: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    return events.withWatermark("ts", late).groupBy(F.session_window("ts", gap), "user_id").agg(F.count("*").alias("n")).select(F.col("session_window.start").alias("start"), "user_id", "n")
