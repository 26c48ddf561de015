"""Model tables from the driver's tables, each a projection that reaches the scan."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

_CASE = "CASE month(o_orderdate) " + " ".join(f"WHEN {i} THEN '{m}'" for i, m in enumerate("January February March April May June July August September October November December".split(), 1)) + " END"

#: SQL that Spark and DuckDB read alike: raw values in several spellings, made from the tables.
RAW_DATE = f"""CASE o_orderkey % 8
 WHEN 0 THEN concat(day(o_orderdate), ' ', {_CASE}, ' ', year(o_orderdate))
 WHEN 1 THEN concat({_CASE}, ' ', day(o_orderdate), 'th, ', year(o_orderdate))
 WHEN 2 THEN concat(substr({_CASE}, 1, 3), '  ', day(o_orderdate))
 WHEN 3 THEN concat({_CASE}, ', ', year(o_orderdate))
 WHEN 4 THEN concat(year(o_orderdate), '-12-01T10:00:00Z')
 WHEN 5 THEN concat('01/02/', year(o_orderdate))
 WHEN 6 THEN concat('Feb 30 ', year(o_orderdate))
 ELSE concat(year(o_orderdate), '-0', 1 + o_orderkey % 9) END"""
RAW_NUMBER = """CASE o_orderkey % 8
 WHEN 0 THEN concat(o_orderkey % 900, 'B')
 WHEN 1 THEN concat('$ ', o_orderkey % 50, '.5 million')
 WHEN 2 THEN concat('Rs. ', o_orderkey % 70, ' crore')
 WHEN 3 THEN concat(1 + o_orderkey % 9, ',250')
 WHEN 4 THEN concat(o_orderkey % 9, 'B/', o_orderkey % 7, 'B')
 WHEN 5 THEN concat(o_orderkey % 100, '%')
 WHEN 6 THEN 'about a dozen'
 ELSE concat('approx. ', o_orderkey % 300, 'k') END"""
RAW_NAME = """concat(p_name, CASE p_partkey % 7 WHEN 0 THEN ' Pvt. Ltd.' WHEN 1 THEN ' (SIH) 2025' WHEN 2 THEN ': makers of parts' WHEN 3 THEN ' - a tag line' WHEN 4 THEN ', Inc.' WHEN 5 THEN ' GmbH 2024' ELSE ' 2025' END)"""
RAW_QUERY = """concat('site:', substr(o_orderpriority, 3), '.org "', o_orderstatus, ' order" AND ', o_orderkey, ' -draft   OR latest')"""
RAW_TEXT = """concat('  ', upper(p_type), '  ', p_name, '   in ', 1990 + p_partkey % 40, CASE WHEN p_partkey % 3 = 0 THEN concat(' and ', 1995 + p_partkey % 20) ELSE '' END)"""
QUOTE = "concat('Order ', l_orderkey, ' had ', cast(l_quantity AS int), ' units for $', cast(floor(l_extendedprice) AS int), ' or ', cast(l_quantity AS int) % 7, '.5 million in all')"
QUOTED_VALUE = "CASE l_orderkey % 5 WHEN 0 THEN concat(cast(l_quantity AS int), '') WHEN 1 THEN concat(cast(floor(l_extendedprice) AS int) + l_linenumber % 2, '') WHEN 2 THEN concat(cast(l_quantity AS int) % 7 * 1000000 + 500000, '') WHEN 3 THEN 'units order' ELSE 'Silver' END"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def incidence_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as entities, years as occasions."""
    return table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("entity"), F.year("o_orderdate").alias("occasion"))


def incidence_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users as entities, days as occasions."""
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("entity"), F.to_date("ts").alias("occasion"))


def claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as entities with a discount that suppliers claim; a supplier's nation is its domain, a line's status its run.

    Rows may share order and line; ``seq`` orders these by what they claim, and is total for fewer than 1000 lines of an order and rows of a line.
    """
    line = Window.partitionBy("l_orderkey", "l_linenumber").orderBy("l_partkey", "l_suppkey", "l_discount", "l_quantity")
    rows = table(spark, sf_dir, "lineitem").withColumn("seq", (F.col("l_orderkey").cast("long") * 1000 + F.col("l_linenumber")) * 1000 + F.row_number().over(line))
    nations = table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    return rows.join(nations, F.col("l_suppkey") == F.col("s_suppkey")).select(
        F.col("l_linestatus").alias("run"), F.col("l_partkey").cast("string").alias("entity"), F.lit("discount").alias("field"), "seq", F.col("l_discount").cast("string").alias("value"),
        F.concat(F.lit("s"), F.col("l_suppkey").cast("string")).alias("url"), F.col("s_nationkey").cast("string").alias("domain"), (F.col("l_quantity") / 50).alias("support"))


def visits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Page visits of capture runs, from events."""
    status = F.when(F.col("event_type") == "error", "failed").when(F.col("value") < 30, "skipped").otherwise("ok")
    return table(spark, sf_dir, "events").select(F.date_format("ts", "yyyy-MM-dd").alias("run"), F.concat(F.lit("capture-"), (F.col("event_id") % 12).cast("string")).alias("capture"), F.concat(F.lit("https://u"), F.col("user_id").cast("string"), F.lit(".example.com")).alias("url"), status.alias("status"), (F.col("event_id") % 4).alias("records_found"), F.col("event_id").alias("seq"))


def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stand-in judge: a deterministic score of each document, some missing."""
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.when(F.col("doc_id") % 17 != 0, (F.col("n_chars") % 101) / 100).alias("score"))


def human_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "labels").select(F.col("doc_id").alias("id"), F.col("quality").alias("correct"))
