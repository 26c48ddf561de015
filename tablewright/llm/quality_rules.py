"""Quality rules whose cutoffs carry a guarantee on wrongly rejected documents.

Each rule rejects a document when one measured rate exceeds a cutoff. A stratum's labelled documents are
dealt by a hash of the id into two sets. The learning set gives a sequence of cutoff
tuples, from lenient to strict: every rule that catches bad documents takes part, and at each
step its cutoff is the one that a certain share of the good learning documents exceeds. The holdout then
tests the tuples in that order: an exact binomial test must reject "more than the allowed share of
good documents would be lost to any of the rules". Testing in a fixed order needs no correction
along the sequence, and the loss is that of all rules together; strata share
the error probability equally (Bonferroni over the strata that are tested). Among the
certified tuples the most lenient one with nearly the best catch is used. About ``log(error) / log(1 - share)`` good
holdout documents are needed before anything can be certified; a stratum with fewer keeps the base rule alone.

Fixed results: a null text has no word; a null stratum value is the stratum
``""``; labels of a null or unknown document are unused; repeated labels of a
document count once, good only if all say so; several rows of one labelled id count each; repeated document rows are judged alike;
a very long text is measured whole, in memory in proportion to it; ties of rates and cutoffs keep the document; an empty table gives no row; other
columns of the input are never read by ``measure``.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import by_size, if_small, scratch, slim, small, staged, texts_of

_BLANKS = " \t\n\x0b\x0c\r"
_SYMBOLS = "#*$%&|<>"
_UPPER = bytes(range(65, 91))
_COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper")

#: Rule name -> (numerator, denominator) among the counts.
RULES = {
    "symbol_rate": ("n_symbols", "word_chars"),
    "dup_line_rate": ("n_dup_lines", "n_lines"),
    "repeat_word_rate": ("n_repeat_words", "n_words"),
    "upper_rate": ("n_upper", "word_chars"),
    "mean_word_chars": ("word_chars", "n_words"),
}

#: Candidate cutoffs: shares in steps of 1/64, and for word lengths steps of a half.
GRID = {name: [k / 64 for k in range(1, 64)] for name in RULES} | {"mean_word_chars": [k / 2 for k in range(8, 64)]}


def repeated_words(words: list, width: int = 3) -> int:
    """How many words stand in a window of ``width`` words that the text has twice or more."""
    windows = list(zip(*(words[k:] for k in range(width))))
    if len(set(windows)) == len(windows):
        return 0
    count: dict = {}
    for w in windows:
        count[w] = count.get(w, 0) + 1
    covered = until = 0
    for i, w in enumerate(windows):
        if count[w] > 1:
            covered += i + width - max(i, until)
            until = i + width
    return covered


def measures(text: str) -> tuple[int, ...]:
    """The counts of one whole text, in the order of ``_COUNTS``."""
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()
    lines = [x for x in raw.split(b"\n") if x and not x.isspace()]
    return (
        len(words),
        len(text) - sum(map(text.count, _BLANKS)),
        sum(map(text.count, _SYMBOLS)),
        len(lines) - len(set(lines)),
        repeated_words(words) if len(words) > 3 else 0,
        len(lines),
        len(raw) - len(raw.translate(None, _UPPER)),
    )


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in by_size(batches):
        rows = [measures(t) for t in texts_of(batch)]
        counts = zip(*rows) if rows else [[]] * len(_COUNTS)
        yield pa.RecordBatch.from_arrays(
            [*(batch.column(c) for c in batch.schema.names if c != "text"), *(pa.array(list(c), pa.int64()) for c in counts)],
            names=[*(c for c in batch.schema.names if c != "text"), *_COUNTS],
        )


def measure(docs: DataFrame, stratum: str = "lang") -> DataFrame:
    """``doc_id``, the stratum and the counts of every document's whole text."""
    kind = dict(docs.dtypes)["doc_id"]
    rows = docs.select("doc_id", F.coalesce(F.col(stratum).cast("string"), F.lit("")).alias("stratum"), "text")
    return rows.mapInArrow(_measure, f"doc_id {kind}, stratum string, " + ", ".join(f"{c} bigint" for c in _COUNTS))


def rates() -> list[Column]:
    """The rules' rates over the counts; a rate without a denominator is 0."""
    return [F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(0.0).alias(name) for name, (a, b) in RULES.items()]


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def binomial_cdf(k: int, n: int, p: float) -> float:
    """P(X <= k) of a binomial, exact up to rounding."""
    if k >= n:
        return 1.0
    if p <= 0 or p >= 1:
        return float(p <= 0)
    log_c = math.lgamma(n + 1)
    return min(1.0, math.fsum(math.exp(log_c - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(p) + (n - i) * math.log1p(-p)) for i in range(k + 1)))


@dataclass(frozen=True)
class Risk:
    """share: of a stratum's good documents that all rules together may reject; error: probability that the promise fails."""

    share: float = 0.02
    error: float = 0.05
    #: A rule takes part, and a tuple is used, only if it catches this share of the stratum's bad documents that pass the base rule.
    least_catch: float = 0.01
    #: One labelled document in so many is for learning; the others are the holdout.
    learning: int = 4


#: Shares of good learning documents that may exceed a cutoff, step by step; before these come steps beyond all of them.
STEPS = (0.0, 0.002, 0.005, 0.01, 0.02, 0.04)
#: Steps above the largest good rate, as factors.
BEYOND = (3.0, 2.0, 1.5, 1.2)


def sequence(rates: dict[str, tuple[list[int], list[int]]], risk: Risk = Risk()) -> list[dict[str, float]]:
    """Cutoff tuples from lenient to strict. ``rates``: rule -> counts of good and of bad learning documents that exceed exactly the first ``i`` cutoffs of its grid."""
    steps: list[dict[str, float]] = [{} for _ in range(len(BEYOND) + len(STEPS))]
    for rule, (good, bad) in sorted(rates.items()):
        grid, n_good, n_bad = GRID[rule], sum(good), sum(bad)
        over = lambda counts, i: sum(counts[i + 1 :])  # noqa: E731  documents above cutoff number i
        if not n_good or not n_bad:
            continue
        at = [next(i for i in range(len(grid)) if i == len(grid) - 1 or over(good, i) <= q * n_good) for q in STEPS]
        # A rule that catches no more bad than good documents at its strictest step would only lose documents.
        strict = at[-1]
        if over(bad, strict) < max(1, risk.least_catch * n_bad) or over(bad, strict) * n_good <= 2 * over(good, strict) * n_bad:
            continue
        cuts = [min(grid, key=lambda g, f=f: abs(g - grid[at[0]] * f)) for f in BEYOND] + [grid[i] for i in at]
        for step, cut in zip(steps, cuts):
            step[rule] = cut
    out: list[dict[str, float]] = []
    for step in steps:
        if step and (not out or step != out[-1]):
            out.append(step)
    return out


def certified(steps: list[dict[str, float]], good: list[int], bad: list[int], share: float, error: float, least: float) -> dict[str, float]:
    """The tuple that is used, or none. ``good[i]`` and ``bad[i]`` count holdout documents that tuple ``i`` is the first to reject, the last entry those that none does."""
    n_good, n_bad, lost, caught, passed = sum(good), sum(bad), 0, 0, []
    for i, step in enumerate(steps):
        lost, caught = lost + good[i], caught + bad[i]
        if not n_good or binomial_cdf(lost, n_good, share) > error:
            break
        passed.append((step, caught))
    best = max((c for _, c in passed), default=0)
    if best == 0 or best < least * n_bad:
        return {}
    return next(step for step, c in passed if c >= 0.97 * best)


def learn_cutoffs(counts: DataFrame, labels: DataFrame, risk: Risk = Risk()) -> dict[str, dict[str, float]]:
    """stratum -> rule -> cutoff, from all labelled documents.

    Only counts reach the driver: by stratum, rule and candidate, then by stratum and tuple, for strata that have enough good
    holdout documents for a certificate. So their number is bounded by that of the labels, whatever the corpus holds.
    """
    marks = slim(labels, "doc_id", "quality").where("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy("doc_id").agg((F.min("quality") == 1).alias("__good"))
    learning = F.pmod(F.xxhash64("doc_id", F.lit(11)), F.lit(risk.learning)) == 0
    seen = staged(counts.where(~base_failed()).join(marks, "doc_id").select("stratum", "__good", learning.alias("__learn"), *rates()), "rates")
    enough = math.log(risk.error) / math.log1p(-risk.share)
    able = staged(seen.where("__good AND NOT __learn").groupBy("stratum").agg(F.count("*").alias("n")).where(F.col("n") >= enough).select("stratum"), "strata")
    seen = seen.join(if_small(able), "stratum", "left_semi")
    bins = [F.struct(F.lit(name).alias("rule"), sum((F.col(name) > c).cast("int") for c in GRID[name]).alias("above")) for name in RULES]
    table = seen.where("__learn").select("stratum", "__good", F.explode(F.array(*bins)).alias("b")).groupBy("stratum", "b.rule", "b.above").agg(F.count_if("__good").alias("good"), F.count_if(~F.col("__good")).alias("bad")).collect()
    hist: dict[str, dict[str, tuple[list[int], list[int]]]] = {}
    for r in table:
        good, bad = hist.setdefault(r["stratum"], {}).setdefault(r["rule"], ([0] * (len(GRID[r["rule"]]) + 1), [0] * (len(GRID[r["rule"]]) + 1)))
        good[r["above"]] += r["good"]
        bad[r["above"]] += r["bad"]
    steps = {s: found for s, rules in hist.items() if (found := sequence(rules, risk))}
    if not steps:
        return {}
    rejects = lambda step: reduce(lambda a, b: a | b, (F.col(r) > c for r, c in step.items()))
    first = [F.when(F.col("stratum") == s, F.coalesce(*(F.when(rejects(step), i) for i, step in enumerate(found)), F.lit(len(found)))) for s, found in steps.items()]
    held = seen.where("NOT __learn").select("__good", "stratum", F.coalesce(*first).alias("i")).where("i IS NOT NULL").groupBy("stratum", "i").agg(F.count_if("__good").alias("good"), F.count_if(~F.col("__good")).alias("bad")).collect()
    tally = {s: ([0] * (len(f) + 1), [0] * (len(f) + 1)) for s, f in steps.items()}
    for r in held:
        tally[r["stratum"]][0][r["i"]] += r["good"]
        tally[r["stratum"]][1][r["i"]] += r["bad"]
    chosen = {s: certified(steps[s], *tally[s], risk.share, risk.error / len(steps), risk.least_catch) for s in sorted(steps)}
    return {s: c for s, c in chosen.items() if c}


def verdict(counts: DataFrame, cutoffs: dict[str, dict[str, float]]) -> DataFrame:
    """Adds ``base_failed``, ``failed_rules`` and ``kept``."""
    spark = counts.sparkSession
    rows = [(s, *(c.get(r) for r in RULES)) for s, c in cutoffs.items()]
    limits = spark.createDataFrame(rows, "__s string, " + ", ".join(f"__{r} double" for r in RULES))
    rate = dict(zip(RULES, rates()))
    failed = F.array_compact(F.array(*(F.when(rate[r] > F.col(f"__{r}"), F.lit(r)) for r in RULES)))
    judged = counts.join(limits, F.col("stratum") == F.col("__s"), "left").withColumn("base_failed", base_failed()).withColumn("failed_rules", failed)
    return judged.withColumn("kept", ~F.col("base_failed") & (F.size("failed_rules") == 0)).drop("__s", *(f"__{r}" for r in RULES))


def quality_report(docs: DataFrame, labels: DataFrame, risk: Risk = Risk(), stratum: str = "lang") -> DataFrame:
    """The counts and verdict of every document; the texts are read once."""
    counts = staged(measure(docs, stratum), "quality")
    return verdict(counts, learn_cutoffs(counts, labels, risk))


def quality_filter(docs: DataFrame, labels: DataFrame, risk: Risk = Risk(), stratum: str = "lang") -> DataFrame:
    """The documents that pass, with their columns.

    The cutoffs come from a pass over all labelled documents; the second pass judges row by
    row where the text lies, so no text is shuffled.
    """
    known = staged(slim(labels, "doc_id").where("doc_id IS NOT NULL").distinct(), "labelled")
    columns = docs.columns
    # Few labels meet the texts where they lie; many meet the counts, so that no text is shuffled.
    counts = measure(docs.join(F.broadcast(known), "doc_id", "left_semi"), stratum) if small(known) else measure(docs, stratum).join(known.hint("merge"), "doc_id", "left_semi")
    with scratch(docs.sparkSession):
        cutoffs = learn_cutoffs(staged(counts, "quality"), labels, risk)
    strata = columns.index(stratum) if stratum in columns else None

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_size(batches):
            texts = texts_of(batch)
            names = [str(s) if s is not None else "" for s in batch.column(strata).to_pylist()] if strata is not None else [""] * len(texts)
            keep = []
            for text, name in zip(texts, names):
                m = dict(zip(_COUNTS, measures(text)))
                ok = m["n_words"] >= 50 and 100 * m["n_repeat_words"] <= 50 * m["n_words"]
                keep.append(ok and not any(m[RULES[r][1]] > 0 and m[RULES[r][0]] / m[RULES[r][1]] > c for r, c in cutoffs.get(name, {}).items()))
            yield batch.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(judge, docs.schema)
