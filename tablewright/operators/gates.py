"""Relevance and filter gates, evidence checks and the claim plan. Scores come from provider columns; a missing one is neutral or passes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import quote_on_page, value_in_quote

PAGE_GATE, FILTER_DROP, UNCERTAIN_BELOW, NEUTRAL = 0.35, 0.2, 0.5, 0.5
GATE_CHARS, FILTER_CHARS = 4000, 1500


def page_gate(rows: DataFrame, p: str = "p") -> DataFrame:
    """Rows that may be relevant; those without a score pass."""
    return rows.where(F.coalesce(p, F.lit(1.0)) >= PAGE_GATE)


def filter_gate(rows: DataFrame, p: str = "p") -> DataFrame:
    """Drops rows that fail a filter and marks those that are uncertain. ``p``: a probability for each filter."""
    p_ = F.transform(p, lambda x: F.coalesce(x, F.lit(NEUTRAL)))
    kept = rows.where(F.coalesce(F.size(p), F.lit(0)) <= 0).withColumn("filter_uncertain", F.lit(False)).unionByName(
        rows.where((F.size(p) > 0) & (F.array_min(p_) >= FILTER_DROP)).withColumn("filter_uncertain", F.exists(p_, lambda x: (x >= FILTER_DROP) & (x < UNCERTAIN_BELOW)))
    )
    return kept


def verify(rows: DataFrame) -> DataFrame:
    """Adds ``verified``: the quote stands on the page and backs the value; evidence that does not is cleared."""
    ok = quote_on_page(F.col("evidence"), F.col("page")) & value_in_quote(F.col("value"), F.col("evidence"))
    return rows.withColumn("verified", ok).withColumn("evidence", F.when(F.col("verified"), F.col("evidence")))


def claim_plan(rows: DataFrame) -> DataFrame:
    """Cells that have a value or evidence."""
    return rows.where("value IS NOT NULL OR evidence IS NOT NULL")


def support(score: Column) -> Column:
    """A claim's support: scored only with both evidence and value, neutral without an answer."""
    return F.when(F.col("evidence").isNotNull() & F.col("value").isNotNull(), F.coalesce(score, F.lit(NEUTRAL)))


def has_primary(rows: DataFrame, primary: str) -> DataFrame:
    """Records whose primary value is there and not empty, zero or false."""
    v = F.col(primary).cast("string")
    return rows.where(v.isNotNull() & ~v.isin("", "0", "0.0", "false"))


def public_metadata(m: Column) -> Column:
    """A map without its keys that begin with an underscore."""
    return F.map_filter(m, lambda k, _: ~F.startswith(k, F.lit("_")))
