"""Capture planning: combinations not tried yet, replanning, and run statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window, WindowSpec

MAX_CAPTURES, MAX_REPLAN_QUERIES, RELAX_BELOW = 12, 3, 3
URLS_PER_CAPTURE, RESULTS_PER_QUERY = 6, 8
#: Seconds between two requests to a domain that states none.
DOMAIN_DELAY = 1.0


def capture_combos(queries: DataFrame, engines: list[str], source_types: list[str] = ["general"]) -> DataFrame:
    """``n, query, engine, source_type``: every combination in the order of planning. The engines and types are parameters, so each query becomes a fixed number of rows."""
    e = F.posexplode(F.array(*(F.lit(x) for x in engines)))
    rows = queries.select("seq", "query", e.alias("ei", "engine")).select("*", F.posexplode(F.array(*(F.lit(x) for x in source_types))).alias("si", "source_type"))
    return rows.withColumn("n", F.row_number().over(Window.orderBy("seq", "ei", "si"))).select("n", "query", "engine", "source_type")


def untried(combos: DataFrame, used: DataFrame, limit: int = MAX_CAPTURES) -> DataFrame:
    return combos.join(used, ["query", "engine", "source_type"], "left_anti").orderBy("n").limit(limit)


def replan_filter(proposed: DataFrame, tried: DataFrame, limit: int = MAX_REPLAN_QUERIES) -> DataFrame:
    """The first proposed queries that were not tried, letter case aside."""
    known = tried.select(F.lower(F.trim("query")).alias("k")).distinct()
    new = proposed.withColumn("k", F.lower(F.trim("query"))).join(known, "k", "left_anti")
    return new.groupBy("k").agg(F.min_by("query", "seq").alias("query"), F.min("seq").alias("seq")).orderBy("seq").limit(limit).select("seq", "query")


def replan_trigger(captures: DataFrame) -> DataFrame:
    """Marks captures that call for new queries: no new entity, or nine tenths of the chunks gated."""
    gated = (F.col("chunks") > 0) & (F.col("gated") >= 0.9 * F.col("chunks"))
    return captures.withColumn("replan", (F.col("new_entities") == 0) | gated)


def in_order(*columns: str) -> WindowSpec:
    """A window over all rows, for tables of a dozen rows."""
    return Window.orderBy(*columns)


def fetch_schedule(urls: DataFrame, delay: float = DOMAIN_DELAY) -> DataFrame:
    """``start_s`` for each of ``domain, rank, url``: a domain's pages one after another, ``crawl_delay`` seconds apart where its rules give one, else ``delay``."""
    wait = F.coalesce("crawl_delay", F.lit(delay)) if "crawl_delay" in urls.columns else F.lit(delay)
    nth = F.row_number().over(Window.partitionBy("domain").orderBy("rank", "url")) - 1
    return urls.withColumn("start_s", nth * wait)


def top_urls(results: DataFrame, k: int = URLS_PER_CAPTURE) -> DataFrame:
    """The first ``k`` distinct URLs of each capture."""
    once = results.groupBy("capture", "url").agg(F.min("rank").alias("rank"))
    return once.withColumn("r", F.row_number().over(Window.partitionBy("capture").orderBy("rank", "url"))).where(F.col("r") <= k).drop("r")


def relaxed(results: DataFrame, more: DataFrame, below: int = RELAX_BELOW) -> DataFrame:
    """Results of each query, with those of its relaxed form added where it had fewer than ``below``; a URL's first place stays."""
    few = results.groupBy("query").agg(F.count("*").alias("n")).where(F.col("n") >= below)
    added = more.join(few, "query", "left_anti").withColumn("rank", F.col("rank") + 1_000_000)
    return results.unionByName(added).groupBy("query", "url").agg(F.min("rank").alias("rank"))


def run_stats(ledger: DataFrame) -> DataFrame:
    """Counters of a run from its ledger: pages by status, distinct URLs, records found."""
    n = lambda c: F.count_if(c)
    s = F.col("status")
    return ledger.groupBy("run").agg(F.count("*").alias("pages"), n(s == "ok").alias("pages_ok"), n(s == "skipped").alias("pages_skipped"), n(s == "failed").alias("pages_failed"), F.countDistinct("url").alias("urls"), F.sum("records_found").alias("records_found"))
