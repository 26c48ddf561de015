"""Scores against gold tables, calibration of the coverage estimate, ablations."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import normalize_name


def f1(p: Column, r: Column) -> Column:
    return 2 * p * r / F.greatest(p + r, F.lit(1e-9))


def _rates(tp: Column, n_pred: Column, n_gold: Column, name: str) -> list[Column]:
    p, r = tp / F.greatest(n_pred, F.lit(1)), tp / F.greatest(n_gold, F.lit(1))
    return [p.alias(f"{name}_precision"), r.alias(f"{name}_recall"), f1(p, r).alias(f"{name}_f1")]


def item_scores(pred: DataFrame, gold: DataFrame) -> DataFrame:
    """Precision, recall and F1 of distinct ``entity_key`` values."""
    sides = pred.select("entity_key", F.lit(1).alias("p"), F.lit(0).alias("g")).unionByName(gold.select("entity_key", F.lit(0).alias("p"), F.lit(1).alias("g")))
    both = sides.groupBy("entity_key").agg(F.max("p").alias("p"), F.max("g").alias("g")).agg(F.sum(F.col("p") * F.col("g")).alias("tp"), F.sum("p").alias("n_pred"), F.sum("g").alias("n_gold"))
    return both.select(*_rates(F.col("tp"), F.col("n_pred"), F.col("n_gold"), "item"), "n_pred", "n_gold")


def row_scores(pred: DataFrame, gold: DataFrame, fields: list[str]) -> DataFrame:
    """As above for rows: right if the entity is there and each gold field that is not null agrees by name."""
    g = gold.select("entity_key", *(F.col(f).alias(f"g_{f}") for f in fields), F.lit(1).alias("g"))
    rows = pred.select("entity_key", *fields, F.lit(1).alias("p")).join(g, "entity_key", "full")
    same = reduce(lambda a, b: a & b, (F.col(f"g_{f}").isNull() | (normalize_name(F.col(f)) == normalize_name(F.col(f"g_{f}"))) for f in fields))
    counts = rows.agg(F.count_if((F.col("p") == 1) & (F.col("g") == 1) & same).alias("tp"), F.count("p").alias("n_pred"), F.count("g").alias("n_gold"))
    return counts.select(*_rates(F.col("tp"), F.col("n_pred"), F.col("n_gold"), "row"), "n_pred", "n_gold")


def true_coverage(item_recall: Column, n_gold: Column) -> Column:
    return F.when(n_gold > 0, F.round(item_recall * n_gold) / n_gold)


def aggregate_metrics(results: DataFrame) -> DataFrame:
    """Means over tasks of ``item_f1, row_f1``, and of the absolute error of ``coverage_est`` where the true coverage is known."""
    error = F.abs(F.col("coverage_est") - true_coverage(F.col("item_recall"), F.col("n_gold")))
    return results.agg(F.count("*").alias("n_tasks"), F.avg("item_f1").alias("mean_item_f1"), F.avg("row_f1").alias("mean_row_f1"), F.avg(error).alias("cce"), F.count(error).alias("n_cce_tasks"))


def calibration_points(results: DataFrame) -> DataFrame:
    """What a calibration plot draws: estimated against true coverage."""
    return results.select("task_id", "coverage_est", true_coverage(F.col("item_recall"), F.col("n_gold")).alias("coverage_true"))


def ablation(results: DataFrame, versions: list[str]) -> DataFrame:
    """Metrics by version, a row for each metric."""
    long = results.unpivot(["version"], ["item_f1", "row_f1", "coverage_est"], "metric", "value")
    return long.groupBy("metric").pivot("version", versions).agg(F.avg("value"))
