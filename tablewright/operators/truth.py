"""Truth discovery: one vote for each source URL, value groups, and ten rounds of trust between sources and values.

Claims are ``run, entity, field, seq, value, url, domain, support``; ``seq`` is a total order within a cell. A cell's work is done on its distinct
(value, domain) pairs with their counts, so a cell with many claims costs no more than its distinct pairs.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..functions.text import normalize_name, normalize_number, number_text
from .merge import by_cell, conflict_list, keys, marked, merged

PRIOR_TRUST, ROUNDS = 0.8, 10


def voters(claims: DataFrame) -> DataFrame:
    """The best supported claim of each cell and URL; the earliest among equals."""
    return _ranked(claims).where("votes").drop("votes")


def _ranked(claims: DataFrame) -> DataFrame:
    best = Window.partitionBy(*keys(claims), "url").orderBy(F.coalesce("support", F.lit(0.0)).desc(), "seq")
    return claims.withColumn("votes", F.row_number().over(best) == 1)


def _sums(groups: np.ndarray, n_groups: int) -> Callable[[np.ndarray], np.ndarray]:
    """Sums by group that do not depend on the order of a group's terms: equal sets of terms have equal sums to the last bit."""
    size = np.bincount(groups, minlength=n_groups)
    few, many = np.flatnonzero(size[groups] <= 2), np.flatnonzero(size[groups] > 2)
    of_few, of_many = groups[few], groups[many]

    def total(terms: np.ndarray) -> np.ndarray:
        out = np.bincount(of_few, terms[few], n_groups).astype(np.float64)
        if len(many):
            t = terms[many]
            order = np.lexsort((t, of_many))
            out += np.bincount(of_many[order], t[order], n_groups)
        return out

    return total


def _places(cell: np.ndarray, names: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct names of each cell: the first row of each, the cell of each, and each row's place among them."""
    codes = names.dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False).astype(np.int64)
    _, first, place = np.unique(cell * (codes.max(initial=0) + 1) + codes, return_index=True, return_inverse=True)
    return first, cell[first], place


def _trust_rounds(rounds: int, prior: float) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Adds to rows of cells with their ``pairs`` (``v, domain, n``) the number of values, and for each pair its value's probability and whether it is the value's first one. Pairs without votes have no probability."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("pairs")
            offsets, flat = np.concatenate(([0], np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False)))), lists.flatten()
            n = flat.field("n").to_numpy(zero_copy_only=False)
            votes = np.flatnonzero(n > 0)
            n, cell = n[votes], np.repeat(np.arange(len(batch)), np.diff(offsets))[votes]
            first, cell_of_value, value = _places(cell, flat.field("v").take(pa.array(votes)))
            firsts, _, domain = _places(cell, flat.field("domain").take(pa.array(votes)))
            by_value, by_domain, by_cell = _sums(value, len(first)), _sums(domain, len(firsts)), _sums(cell_of_value, len(batch))
            starts = np.flatnonzero(np.diff(cell_of_value, prepend=-1))
            n_domain, trust, p = by_domain(n), np.full(len(firsts), prior), np.ones(len(first))
            for _ in range(rounds):
                t = np.clip(trust, 0.01, 0.99)
                score = by_value(n * np.log(t / (1 - t))[domain])
                top = np.zeros(len(batch))
                if len(starts):
                    top[cell_of_value[starts]] = np.maximum.reduceat(score, starts)
                e = np.exp(score - top[cell_of_value])
                p = e / by_cell(e)[cell_of_value]
                trust = by_domain(n * p[value]) / n_domain
            n_values = np.bincount(cell_of_value, minlength=len(batch))
            p[n_values[cell_of_value] == 1] = 1.0
            prob, voted, head = np.zeros(len(flat)), np.zeros(len(flat), bool), np.zeros(len(flat), bool)
            prob[votes], voted[votes], head[votes[first]] = p[value], True, True
            ends = pa.array(offsets.astype(np.int32))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.ListArray.from_arrays(ends, pa.array(prob, mask=~voted)), pa.ListArray.from_arrays(ends, pa.array(head)), pa.array(n_values.astype(np.int32))], names=[*batch.schema.names, "p", "head", "n_values"])

    return run


def _solved(cells: DataFrame, rounds: int, prior: float) -> DataFrame:
    added = [T.StructField("p", T.ArrayType(T.DoubleType())), T.StructField("head", T.ArrayType(T.BooleanType())), T.StructField("n_values", T.IntegerType())]
    return cells.mapInArrow(_trust_rounds(rounds, prior), T.StructType([*cells.schema.fields, *added]))


def value_probabilities(votes: DataFrame, value: Column | None = None, rounds: int = ROUNDS, prior: float = PRIOR_TRUST) -> DataFrame:
    """``run, entity, field, v, prob, n_values``: the probability of each value group of a cell.

    A round costs time in proportion to a cell's pairs, and its sums do not depend on their order: values whose votes are alike stay equal, where a last bit would grow from round to round.
    Votes that are already parted by cell (``merge.by_cell``) are not shuffled again.
    """
    key = keys(votes)
    v = normalize_name(F.col("value")) if value is None else value
    pairs = votes.select(*key, v.alias("v"), "domain").groupBy(*key, "v", "domain").agg(F.count("*").cast("double").alias("n"))
    cells = pairs.groupBy(*key).agg(F.collect_list(F.struct("v", "domain", "n")).alias("pairs"))
    out = _solved(cells, rounds, prior).select(*key, "n_values", F.inline(F.arrays_zip(F.col("pairs.v").alias("v"), F.col("p").alias("prob"), F.col("head").alias("head"))))
    return out.where("head").select(*key, "v", "prob", "n_values")


def claim_probabilities(claims: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """Every claim with ``prob``: its value group's for a voter, 0 for a claim that does not vote in a conflicted cell, as for any other non-voter."""
    ranked = _ranked(claims.withColumn("v", normalize_name(F.col("value"))))
    probs = value_probabilities(ranked.where("votes"), F.col("v"), rounds)
    return ranked.join(probs, [*keys(claims), "v"], "left").withColumn("prob", F.when(F.col("votes"), F.round("prob", 4)).otherwise(0.0))


def winners(claims: DataFrame) -> DataFrame:
    """The claim with the highest probability of each cell, the earliest among equals, and the cell's numbers of claims and values."""
    key = keys(claims)
    return _won(by_cell(claims)).select(*key, "w.value", "w.url", "w.prob", "n_values", "n_claims")


def _won(claims: DataFrame, more: dict[str, tuple[Column, Callable[[Column], Column]]] | None = None) -> DataFrame:
    """Cells with their winning claim ``w``. ``more`` has further columns of cells: what is taken of a pair's claims, and of the cell's pairs.

    Of a value's voters only the earliest can win; of claims without a vote, whose probability is 0, only the cell's earliest.
    """
    key, more = keys(claims), more or {}
    ranked = _ranked(claims.withColumn("v", normalize_name(F.col("value"))))
    claim = F.struct("seq", "value", "url")
    pairs = ranked.groupBy(*key, "v", "domain").agg(F.count_if("votes").cast("double").alias("n"), F.min(F.when(F.col("votes"), claim)).alias("best"), F.min(F.when(~F.col("votes"), claim)).alias("other"), F.count("*").alias("n_claims"), *(c.alias(k) for k, (c, _) in more.items()))
    cells = pairs.groupBy(*key).agg(F.collect_list(F.struct("v", "domain", "n")).alias("pairs"), F.collect_list(F.struct("n", "best")).alias("bests"), F.min("other").alias("other"), F.sum("n_claims").alias("n_claims"), *(f(F.col(k)).alias(k) for k, (_, f) in more.items()))
    entry = lambda prob, c: F.struct(prob.alias("prob"), (-c["seq"]).alias("late"), c["value"].alias("value"), c["url"].alias("url"))
    voted = F.transform(F.filter(F.arrays_zip("bests", "p"), lambda x: x["p"].isNotNull()), lambda x: entry(F.round(x["p"], 4), x["bests"]["best"]))
    rest = F.when(F.col("other").isNull(), F.array()).otherwise(F.array(entry(F.lit(0.0), F.col("other"))))
    return _solved(cells, ROUNDS, PRIOR_TRUST).withColumn("w", F.array_max(F.concat(voted, rest)))


def resolve(records: DataFrame, claims: DataFrame, numeric: list[str] | None = None) -> DataFrame:
    """``records`` cells (``run, entity, field, value, url, conflicts``) with winners written into those that have conflicts and at least two claims.

    Cells of the ``numeric`` fields stay numbers: the winner's number is compared and written; one that is no number, or zero, changes nothing.
    """
    key = keys(records)
    won = winners(claims).select(*key, F.col("value").alias("new_value"), F.col("url").alias("new_url"), F.col("prob").alias("kbt_prob"), "n_claims")
    return _written(records.join(won, key, "left"), records.columns, numeric)


def resolved_records(claims: DataFrame, numeric: list[str] | None = None) -> DataFrame:
    """``resolve`` of the claims' own records, from one pass over the claims."""
    key = keys(claims)
    cells = _won(marked(by_cell(claims)), {"e": (F.max("e"), F.max), "c": (conflict_list(), lambda c: F.flatten(F.collect_list(c)))}).where("e IS NOT NULL")
    cells = cells.select(*key, "e", "c", F.col("w.value").alias("new_value"), F.col("w.url").alias("new_url"), F.col("w.prob").alias("kbt_prob"), "n_claims")
    rows = cells.select(*merged(cells, key, "new_value", "new_url", "kbt_prob", "n_claims"))
    return _written(rows, rows.columns, numeric)


def _written(joined: DataFrame, columns: list[str], numeric: list[str] | None) -> DataFrame:
    """Records beside their winners with these written in where they are used."""
    key = keys(joined)
    number = normalize_number(F.col("new_value"))
    counts = F.col("field").isin(numeric or [])
    new = F.when(counts, number_text(F.nullif(number, F.lit(0.0)))).otherwise(F.col("new_value"))
    other = F.when(counts, ~number.eqNullSafe(F.col("value").try_cast("double"))).otherwise(~F.col("new_value").eqNullSafe(F.col("value")))
    use = (F.size("conflicts") > 0) & (F.col("n_claims") >= 2) & (F.coalesce(new, F.lit("")) != "") & other
    out = joined.withColumn("resolved", F.coalesce(use, F.lit(False)))
    rest = [c for c in ("corroborated_by", "verified") if c in columns]
    return out.select(*key, F.when(F.col("resolved"), new).otherwise(F.col("value")).alias("value"), F.when(F.col("resolved"), F.col("new_url")).otherwise(F.col("url")).alias("url"), "conflicts", *rest, F.when(F.col("resolved"), F.col("kbt_prob")).alias("kbt_prob"), F.when(F.col("resolved"), F.format_string("Resolved from %d conflicting sources", F.size("conflicts") + 1)).alias("conflict_note"), "resolved")


def resolved_counts(resolved: DataFrame) -> DataFrame:
    return resolved.where("resolved").groupBy(*keys(resolved, "entity")).agg(F.count("*").alias("resolved_cells"))
