"""Completeness by capture and recapture: incidence ``(entity, occasion)``, Chao's estimate, bootstrap, trajectory, stop rule."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

REPLICATES, LOW, HIGH, SEED = 500, 5.0, 95.0, 42
MIN_YIELD, MIN_CAPTURES = 0.02, 3


def frequencies(incidence: DataFrame) -> DataFrame:
    """One row: observed entities, those seen once and twice, and occasions with a detection."""
    seen = incidence.groupBy("entity").agg(F.countDistinct("occasion").alias("k"))
    counts = seen.agg(F.count("*").alias("s_obs"), F.count_if(F.col("k") == 1).alias("q1"), F.count_if(F.col("k") == 2).alias("q2"))
    return counts.crossJoin(incidence.agg(F.countDistinct("occasion").alias("t")))  # one row each


def chao2(s: Column, q1: Column, q2: Column, t: Column) -> Column:
    """Estimated number of entities; the observed one where there are fewer than two occasions."""
    d = lambda c: c.cast("double")
    return F.when((t < 2) | (s == 0), d(s)).otherwise(F.greatest(d(s), d(s) + (d(t) - 1) / d(t) * d(q1) * (d(q1) - 1) / (2 * (d(q2) + 1))))


def estimate(incidence: DataFrame) -> DataFrame:
    return frequencies(incidence).withColumn("s_hat", chao2(*(F.col(c) for c in ("s_obs", "q1", "q2", "t"))))


def patterns(incidence: DataFrame) -> DataFrame:
    """Entities by the set of their occasions. Replicates work on these, whose number does not grow with the entities."""
    sets = incidence.groupBy("entity").agg(F.array_sort(F.collect_set("occasion")).alias("occasions"))
    return sets.groupBy("occasions").agg(F.count("*").alias("entities"))


def _drawn(steps: DataFrame, replicates: int, seed: int) -> DataFrame:
    """``t, rep, at``: for each step ``t``, the places from 1 to ``t`` that a replicate draws at least once, by a hash that SQL can repeat."""
    draws = steps.select("t", F.explode(F.sequence(F.lit(0), F.lit(replicates - 1))).alias("rep")).select("t", "rep", F.explode(F.sequence(F.lit(1), "t")).alias("i"))
    number = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(seed).cast("string"), F.col("rep").cast("string"), F.col("i").cast("string"))), 1, 8), 16, 10).cast("long")
    return draws.select("t", "rep", (1 + number % F.col("t")).cast("int").alias("at")).distinct()


def _order(incidence: DataFrame) -> DataFrame:
    """``occasion, t``: occasions numbered in order. A run has a dozen of them; whole tables have as many as they have days or years."""
    return incidence.select("occasion").distinct().withColumn("t", F.row_number().over(Window.orderBy("occasion")))


def bootstrap(incidence: DataFrame, replicates: int = REPLICATES, seed: int = SEED, each_step: bool = False) -> DataFrame:
    """``t, rep, s_hat``: estimates with as many occasions drawn anew; after all occasions, or with ``each_step`` after each of them."""
    order = _order(incidence)
    steps = order.select("t") if each_step else order.agg(F.max("t").alias("t")).where("t IS NOT NULL")
    held = patterns(incidence).select(F.xxhash64("occasions").alias("pattern"), "entities", F.explode("occasions").alias("occasion")).join(order, "occasion").select("pattern", "entities", F.col("t").alias("at"))
    met = _drawn(steps, replicates, seed).join(held, "at").groupBy("t", "rep", "pattern").agg(F.count("*").alias("k"), F.first("entities").alias("entities"))
    sums = met.groupBy("t", "rep").agg(F.sum("entities").alias("s"), F.sum(F.when(F.col("k") == 1, F.col("entities")).otherwise(0)).alias("q1"), F.sum(F.when(F.col("k") == 2, F.col("entities")).otherwise(0)).alias("q2"))
    return sums.select("t", "rep", chao2(F.col("s"), F.col("q1"), F.col("q2"), F.col("t")).alias("s_hat"))


def _interval(values: DataFrame, low: float, high: float) -> DataFrame:
    lo = F.greatest(F.lit(0), F.floor(low / 100 * F.size("v")).cast("int") - 1)
    hi = F.least(F.size("v") - 1, F.floor(high / 100 * F.size("v")).cast("int"))
    return values.withColumns({"ci_lo": F.get("v", lo), "ci_hi": F.get("v", hi)}).drop("v")


def bootstrap_interval(incidence: DataFrame, replicates: int = REPLICATES, low: float = LOW, high: float = HIGH, seed: int = SEED) -> DataFrame:
    """``ci_lo, ci_hi`` by nearest rank, one row."""
    return _interval(bootstrap(incidence, replicates, seed).agg(F.array_sort(F.collect_list("s_hat")).alias("v")), low, high)  # as many as replicates


def share(s: Column, bound: Column) -> Column:
    return F.when(bound > 0, F.least(F.lit(1.0), s / bound)).otherwise(1.0)


def summary(incidence: DataFrame, replicates: int = REPLICATES) -> DataFrame:
    both = estimate(incidence).crossJoin(bootstrap_interval(incidence, replicates))
    flat = (F.col("t") < 2) | (F.col("s_obs") < 2)
    both = both.withColumns({c: F.when(flat, F.col("s_obs").cast("double")).otherwise(F.col(c)) for c in ("ci_lo", "ci_hi")})
    s = F.col("s_obs")
    return both.select("s_obs", "s_hat", F.col("ci_lo").alias("ci_lo_s"), F.col("ci_hi").alias("ci_hi_s"), share(s, F.col("s_hat")).alias("coverage_est"), share(s, F.col("ci_hi")).alias("coverage_lo"), share(s, F.col("ci_lo")).alias("coverage_hi"), F.col("t"))


def trajectory(incidence: DataFrame) -> DataFrame:
    """``t, occasion, new_entities, s_obs, q1, q2, s_hat`` after each occasion, in one pass: an entity changes the counts at its first, second and third detection.

    Running sums are over occasions, which are few against detections; these meet their numbers on a plain join.
    """
    order = _order(incidence)
    ranked = incidence.distinct().join(order, "occasion").withColumn("r", F.row_number().over(Window.partitionBy("entity").orderBy("t")))
    steps = ranked.where("r <= 3").groupBy("t").agg(*(F.count_if(F.col("r") == k).alias(f"n{k}") for k in (1, 2, 3)))
    all_steps = order.join(steps, "t", "left").na.fill(0, ["n1", "n2", "n3"])
    upto = Window.orderBy("t").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    run = lambda c: F.sum(c).over(upto)
    out = all_steps.select("t", "occasion", F.col("n1").alias("new_entities"), run("n1").alias("s_obs"), (run("n1") - run("n2")).alias("q1"), (run("n2") - run("n3")).alias("q2"))
    return out.withColumn("s_hat", chao2(*(F.col(c) for c in ("s_obs", "q1", "q2", "t"))))


def trajectory_bounds(incidence: DataFrame, replicates: int = REPLICATES, low: float = LOW, high: float = HIGH, seed: int = SEED) -> DataFrame:
    """The trajectory with ``ci_lo, ci_hi, coverage_est, coverage_lo, coverage_hi`` of each step; before two occasions or entities the observed number stands for all of these."""
    bounds = _interval(bootstrap(incidence, replicates, seed, each_step=True).groupBy("t").agg(F.array_sort(F.collect_list("s_hat")).alias("v")), low, high)
    s, flat = F.col("s_obs"), (F.col("t") < 2) | (F.col("s_obs") < 2)
    steps = trajectory(incidence).join(bounds, "t", "left")
    steps = steps.withColumns({c: F.when(flat | F.col(c).isNull(), s.cast("double")).otherwise(F.col(c)) for c in ("ci_lo", "ci_hi")})
    return steps.withColumns({"coverage_est": share(s, F.col("s_hat")), "coverage_lo": share(s, F.col("ci_hi")), "coverage_hi": share(s, F.col("ci_lo"))})


def marginal_yield(steps: DataFrame) -> DataFrame:
    """Adds the mean of the last four steps' new entities relative to the mean of all so far; 1 for a single step."""
    all_, last = Window.orderBy("t").rowsBetween(Window.unboundedPreceding, 0), Window.orderBy("t").rowsBetween(-3, 0)
    rate = F.avg("new_entities").over(last) / F.greatest(F.lit(1.0), F.avg("new_entities").over(all_))
    return steps.withColumn("marginal_yield", F.when(F.count("*").over(all_) < 2, 1.0).otherwise(rate))


def stop_capture(steps: DataFrame, target_coverage: float = 0.8, target_count: int = 20) -> DataFrame:
    """Marks each step of ``trajectory_bounds`` at which the search may stop: the coverage by the interval's upper bound is met, or the yield has run dry."""
    some = (F.col("t") >= 2) & (F.col("s_obs") >= 2)
    met = (F.col("t") >= MIN_CAPTURES) & (F.col("s_obs") >= min(target_count, 5)) & (F.col("coverage_lo") >= target_coverage)
    dry = (F.col("marginal_yield") < MIN_YIELD) & (F.col("t") >= MIN_CAPTURES + 1)
    return marginal_yield(steps).withColumn("stop", some & (met | dry))
