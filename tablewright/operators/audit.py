"""Accuracy audit: prediction-powered inference, an audit sample, and a conformal acceptance threshold."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

Z, NEUTRAL = 1.96, 0.5


def ppi_accuracy(scores: DataFrame, labels: DataFrame | None = None, z: float = Z) -> DataFrame:
    """``theta_hat, ci_low, ci_high, se, n_cells, n_labeled``: mean of ``scores(id, score)`` corrected by ``labels(id, correct)``. A missing score is neutral."""
    f = scores.select("id", F.coalesce("score", F.lit(NEUTRAL)).alias("f"))
    if labels is None:
        labels = scores.select("id", F.lit(None).cast("int").alias("correct")).limit(0)
    rows = f.join(labels.select("id", F.col("correct").cast("double").alias("y")), "id", "left")
    d = F.col("y") - F.col("f")
    moments = rows.agg(F.count("*").alias("n_cells"), F.count("y").alias("n_labeled"), F.avg("f").alias("mu_f"), F.coalesce(F.var_samp("f"), F.lit(0.0)).alias("var_f"), F.avg(d).alias("mu_d"), F.coalesce(F.var_samp(d), F.lit(0.0)).alias("var_d"))
    theta = F.col("mu_f") + F.coalesce("mu_d", F.lit(0.0))
    se = F.sqrt(F.col("var_f") / F.col("n_cells") + F.when(F.col("n_labeled") > 0, F.col("var_d") / F.col("n_labeled")).otherwise(0.0))
    clip = lambda c: F.greatest(F.lit(0.0), F.least(F.lit(1.0), c))
    some = F.col("n_cells") > 0
    return moments.select(*(F.when(some, c).otherwise(0.0).alias(n) for n, c in (("theta_hat", clip(theta)), ("ci_low", clip(theta - z * se)), ("ci_high", clip(theta + z * se)), ("se", se))), "n_cells", "n_labeled")


def audit_sample(claims: DataFrame, n: int = 30, seed: int = 42) -> DataFrame:
    """``n`` claims for labelling: up to half from the uncertain band, the rest from the others, in an order by hash."""
    uncertain = F.coalesce(F.col("score").between(0.3, 0.7), F.lit(False))
    key = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("id").cast("string")))
    rows = claims.withColumn("uncertain", uncertain).withColumn("key", key)
    parts = [rows.where(c).orderBy("key", "id").limit(k) for c, k in ((F.col("uncertain"), n // 2), (~F.col("uncertain"), n))]  # top-k on either side, no full sort
    drawn = parts[0].unionByName(parts[1]).withColumn("r", F.row_number().over(Window.orderBy(F.col("uncertain").desc(), "key", "id")))
    return drawn.where(F.col("r") <= n).drop("r", "key")


#: Equal ranges of scores over which running sums go first, so that no task sorts all scores.
BUCKETS = 1024


def conformal_threshold(scores: DataFrame, alpha: float = 0.05, delta: float = 0.1, lowest: bool = False) -> DataFrame:
    """``tau``: a score above which errors keep to ``alpha`` with Hoeffding's margin; the highest such score, or with ``lowest`` the lowest; 1 if there is none. Rows without a score count nowhere."""
    bucket = F.least(F.greatest(F.floor(F.col("score") * BUCKETS), F.lit(0)), F.lit(BUCKETS)).cast("int")
    by_score = scores.where("score IS NOT NULL").groupBy("score").agg(F.count("*").alias("n"), F.count_if(F.col("correct") == 0).alias("wrong")).withColumn("bucket", bucket)
    higher = Window.orderBy(F.col("bucket").desc()).rowsBetween(Window.unboundedPreceding, -1)
    before = by_score.groupBy("bucket").agg(F.sum("n").alias("n"), F.sum("wrong").alias("wrong"))  # a row for each range
    before = before.select("bucket", *(F.coalesce(F.sum(c).over(higher), F.lit(0)).alias(f"{c}_before") for c in ("n", "wrong")))
    above = Window.partitionBy("bucket").orderBy(F.col("score").desc()).rowsBetween(Window.unboundedPreceding, 0)
    run = by_score.join(F.broadcast(before), "bucket").select("score", *((F.sum(c).over(above) + F.col(f"{c}_before")).alias(c) for c in ("n", "wrong")))
    ok = run.where(F.col("wrong") / F.col("n") + F.sqrt(F.lit(math.log(1 / delta)) / (2 * F.col("n"))) <= alpha)
    return ok.agg(F.coalesce((F.min if lowest else F.max)("score"), F.lit(1.0)).alias("tau"), F.count("*").alias("n_qualifying"))
