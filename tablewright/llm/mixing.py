"""Mixing sources to target weights by temperature.

A source's weight is its token share raised to an exponent, normalised. The exponent is
bisected between 0 (all sources alike) and 1 (shares as they are): the smallest one
at which no source is repeated more than ``repetition_limit`` times as often as the least
repeated one, or the one at which the weights reach ``target_entropy`` (a share of
the largest possible entropy). Weights times the budget are token targets. Each source
fills its target with blocks: seeded permutations of its documents, all whole but the
last, which ends at the last document that the target has room for.

Without a budget, the smallest one is taken at which every document is used at least once.

Places inside permutations come from two-level prefix sums: totals of hash ranges first,
then a running sum inside each range. So a source that holds most rows is spread over
thousands of ranges. Only one row for each source (and one for each source and range, as a table) is gathered.

Fixed results: tokens are words parted by ASCII blanks; a null text has none; a null
source is a source of its own; a source without any token keeps its documents once; a null
id is permuted like a value; the permutation's key is a hash of block, id and text, so rows equal in both have equal keys, and rows of equal keys
are admitted to the last block together or not at all; texts of any length are counted where they lie; an empty table gives an empty mix; other
columns pass through ``mix_documents``.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import if_small, staged

#: Hexadecimal digits of the permutation key that name a range: 4096 ranges a source and block.
RANGE_DIGITS = 3
SEED = 20


@dataclass(frozen=True)
class Target:
    """Exactly one of ``repetition_limit`` and ``target_entropy``; ``budget`` in tokens."""

    repetition_limit: float | None = 1.5
    target_entropy: float | None = None
    budget: int | None = None


def exponent(tokens: list[int], target: Target) -> float:
    """The exponent for the sources' token counts (all positive), by bisection."""
    if (target.repetition_limit is None) == (target.target_entropy is None):
        raise ValueError("give a repetition limit or a target entropy")
    total = sum(tokens)

    def met(a: float) -> bool:
        p = weights(tokens, a)
        if target.repetition_limit is not None:
            times = [x / (t / total) for x, t in zip(p, tokens)]
            return max(times) <= target.repetition_limit * min(times)
        return -math.fsum(x * math.log(x) for x in p if x > 0) <= target.target_entropy * math.log(max(2, len(p)))

    low, high = 0.0, 1.0
    if not tokens or met(low):
        return low
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (low, mid) if met(mid) else (mid, high)
    return high


def weights(tokens: list[int], a: float) -> list[float]:
    total = sum(tokens)
    raw = [(t / total) ** a for t in tokens]
    norm = math.fsum(raw)
    return [x / norm for x in raw]


def targets(tokens: dict[str, int], target: Target) -> dict[str, int]:
    """Token targets by source."""
    names = sorted(k for k, t in tokens.items() if t > 0)
    counts = [tokens[k] for k in names]
    p = weights(counts, exponent(counts, target)) if names else []
    budget = target.budget if target.budget is not None else max((t / x for t, x in zip(counts, p)), default=0)
    return {k: 0 for k in tokens} | {k: math.floor(x * budget + 0.5) for k, x in zip(names, p)}


def _source_key() -> Column:
    return F.coalesce(F.concat(F.lit("="), F.col("source").cast("string")), F.lit("null"))


def _n_tokens() -> Column:
    return F.coalesce(F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def _key(block: Column, seed: int, text_md5: Column) -> Column:
    return F.substring(F.md5(F.concat_ws(":", F.lit(seed).cast("string"), block.cast("string"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), text_md5)), 1, 16)


def _text_md5() -> Column:
    return F.md5(F.coalesce("text", F.lit("")))


def mixing_plan(rows: DataFrame, target: Target) -> DataFrame:
    """``src, tokens, target, blocks, rest``: a row for each source. ``blocks`` permutations are whole; ``rest`` tokens are left for the last."""
    spark = rows.sparkSession
    tokens = {r[0]: r[1] for r in rows.groupBy("src").agg(F.sum("n_tokens")).collect()}  # a row for each source
    goal = targets(tokens, target)
    plan = [(s, t, goal[s] if t else 0, goal[s] // t if t else 1, goal[s] % t if t else 0) for s, t in sorted(tokens.items())]
    return spark.createDataFrame(plan, "src string, tokens long, target long, blocks long, rest long")


def _sizes(docs: DataFrame) -> DataFrame:
    return staged(docs.select("doc_id", "source", _source_key().alias("src"), _n_tokens().alias("n_tokens"), _text_md5().alias("text_md5")), "mix")


def mix_schedule(docs: DataFrame, target: Target = Target(), seed: int = SEED) -> DataFrame:
    """Every drawn document: its source, block, place ``start`` in its source's stream, and ``at``, the share of the stream
    before it. Ordering by ``at`` interleaves the sources by their weights.
    """
    rows = _sizes(docs)
    plan = mixing_plan(rows, target)
    drawn = rows.join(if_small(plan), "src").withColumn("block", F.explode(F.expr("sequence(0L, blocks - IF(rest > 0, 0, 1))"))) if not plan.isEmpty() else rows.limit(0).select("*", *(F.lit(0).cast("long").alias(c) for c in ("tokens", "target", "blocks", "rest", "block")))
    drawn = drawn.where("block >= 0").withColumn("key", _key(F.col("block"), seed, F.col("text_md5"))).withColumn("range", F.substring("key", 1, RANGE_DIGITS))
    ranges = drawn.groupBy("src", "block", "range").agg(F.sum("n_tokens").alias("held"))
    before = ranges.withColumn("before", F.sum("held").over(Window.partitionBy("src", "block").orderBy("range")) - F.col("held")).drop("held")
    inside = Window.partitionBy("src", "block", "range").orderBy("key")
    placed = drawn.join(before, ["src", "block", "range"]).withColumn("place", F.col("before") + F.coalesce(F.sum("n_tokens").over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    # Rows of equal keys share the end of the last of them.
    chosen = placed.withColumn("end", F.col("before") + F.sum("n_tokens").over(inside.rangeBetween(Window.unboundedPreceding, Window.currentRow))).where("block < blocks OR end <= rest")
    start = F.col("block") * F.col("tokens") + F.col("place")
    return chosen.select("doc_id", "source", "block", "n_tokens", start.alias("start"), F.col("target"), F.when(F.col("target") > 0, start / F.col("target")).otherwise(0.0).alias("at"))


def mix_documents(docs: DataFrame, target: Target = Target(), seed: int = SEED) -> DataFrame:
    """The documents, each as often as the mix draws it.

    The cut of a source's last block is one key for each source, so the texts are read and
    repeated where they lie, without a shuffle.
    """
    rows = _sizes(docs)
    plan = mixing_plan(rows, target)
    if plan.isEmpty():
        return docs
    cut = rows.join(if_small(plan.where("rest > 0")), "src").withColumn("key", _key(F.col("blocks"), seed, F.col("text_md5"))).withColumn("range", F.substring("key", 1, RANGE_DIGITS))
    ranges = cut.groupBy("src", "range").agg(F.sum("n_tokens").alias("held"), F.first("rest").alias("rest"))
    ends = ranges.withColumn("end", F.sum("held").over(Window.partitionBy("src").orderBy("range")))
    # The range in which the rest is used up: what it holds is little; whole ranges before it are in.
    edge = staged(ends.where("end > rest").groupBy("src").agg(F.min(F.struct("range", (F.col("rest") - F.col("end") + F.col("held")).alias("left"))).alias("e")).select("src", "e.range", "e.left"), "edge")
    inside = Window.partitionBy("src").orderBy("key").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    last = cut.join(if_small(edge), ["src", "range"]).withColumn("sum", F.sum("n_tokens").over(inside)).where("sum <= left")
    last = last.groupBy("src").agg(F.max("key").alias("last"))
    cuts = plan.join(edge, "src", "left").join(last, "src", "left").select(F.col("src").alias("__src"), F.col("blocks").alias("__blocks"), F.col("rest").alias("__rest"), F.col("range").alias("__range"), F.col("last").alias("__last"))
    cuts = staged(cuts, "cuts")
    joined = docs.join(if_small(cuts), _source_key() == F.col("__src")).withColumn("__key", _key(F.col("__blocks"), seed, _text_md5()))
    whole = F.substring("__key", 1, RANGE_DIGITS) < F.col("__range")
    partly = F.coalesce(F.col("__key") <= F.col("__last"), F.lit(False))
    extra = F.when((F.col("__rest") > 0) & (F.coalesce(whole, F.lit(True)) | partly), 1).otherwise(0)
    copies = F.explode(F.expr("array_repeat(0, cast(__n AS int))"))
    return joined.withColumn("__n", F.col("__blocks") + extra).where("__n > 0").select(*(docs[c] for c in docs.columns), copies.alias("__copy")).drop("__copy")


#: The schedule in DuckDB's SQL for the defaults: the same bisection as a recursive query, the same keys.
ORACLE_SQL = r"""
WITH RECURSIVE sized AS (
  SELECT doc_id, source, coalesce('=' || source, 'null') AS src,
         CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS n_tokens, md5(coalesce(text, '')) AS text_md5 FROM documents),
totals AS (SELECT src, CAST(sum(n_tokens) AS BIGINT) AS tokens FROM sized GROUP BY src),
shares AS (SELECT src, tokens, tokens / sum(tokens) OVER () AS share FROM totals WHERE tokens > 0),
bisect(i, low, high) AS (
  SELECT 0, CAST(0 AS DOUBLE), CAST(1 AS DOUBLE)
  UNION ALL
  SELECT i + 1, CASE WHEN ok THEN low ELSE (low + high) / 2 END, CASE WHEN ok THEN (low + high) / 2 ELSE high END
  FROM (SELECT i, low, high, (SELECT max(pow(share, (low + high) / 2) / share) <= 1.5 * min(pow(share, (low + high) / 2) / share) FROM shares) AS ok
        FROM bisect WHERE i < 60)),
found AS (SELECT CASE WHEN (SELECT max(1 / share) <= 1.5 * min(1 / share) FROM shares) THEN 0 ELSE high END AS a FROM bisect WHERE i = 60),
weighted AS (SELECT src, tokens, pow(share, a) / sum(pow(share, a)) OVER () AS p FROM shares, found),
goals AS (SELECT src, tokens, CAST(floor(p * max(tokens / p) OVER () + 0.5) AS BIGINT) AS target FROM weighted),
plan AS (SELECT src, tokens, target, target // tokens AS blocks, target % tokens AS rest FROM goals
         UNION ALL SELECT src, 0, 0, 1, 0 FROM totals WHERE tokens = 0),
drawn AS (SELECT s.*, p.tokens, p.target, p.blocks, p.rest, unnest(generate_series(0, blocks - CASE WHEN rest > 0 THEN 0 ELSE 1 END)) AS block
          FROM sized s JOIN plan p USING (src)),
keyed AS (SELECT *, substr(md5('20:' || block || ':' || coalesce(CAST(doc_id AS VARCHAR), '') || ':' || text_md5), 1, 16) AS key FROM drawn),
placed AS (SELECT *, coalesce(sum(n_tokens) OVER (PARTITION BY src, block ORDER BY key ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS place,
           sum(n_tokens) OVER (PARTITION BY src, block ORDER BY key RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS fill FROM keyed)
SELECT doc_id, source, CAST(block AS BIGINT) AS block, n_tokens, CAST(block * tokens + place AS BIGINT) AS start, CAST(target AS BIGINT) AS target,
       CASE WHEN target > 0 THEN (block * tokens + place) / target ELSE 0 END AS at
FROM placed WHERE block < blocks OR fill <= rest
"""
