"""Writers: CSV export, appended and keyed tables, JSON results."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_csv(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").option("header", True).csv(path)


def append(rows: DataFrame, path: str, partition: str | None = "run") -> None:
    """Adds rows to a table; the run is its partition, so readers of a run read its files only."""
    writer = rows.write.mode("append")
    (writer.partitionBy(partition) if partition and partition in rows.columns else writer).parquet(path)


def overwrite_columns(rows: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    """An update by key: columns of ``changes`` replace those of the rows with its keys."""
    new = changes.select(F.col(key), *(F.col(c).alias(f"__{c}") for c in changes.columns if c != key), F.lit(True).alias("__hit"))
    joined = rows.join(new, key, "left")
    return joined.select(*((F.when(F.col("__hit"), F.col(f"__{c}")).otherwise(F.col(c)).alias(c) if c in changes.columns and c != key else F.col(c)) for c in rows.columns))


def write_json(rows: DataFrame, path: str) -> None:
    rows.select(F.to_json(F.struct("*")).alias("value")).write.mode("overwrite").text(path)


def read_json(spark, path: str, schema: str) -> DataFrame:
    """Result or gold files; a malformed one gives nulls instead of failing the job."""
    return spark.read.schema(schema).option("multiLine", True).option("mode", "PERMISSIVE").json(path)
