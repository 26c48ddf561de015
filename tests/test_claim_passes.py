"""Queries over claims read and shuffle these once, and alike values stay alike."""

import random

import pytest

from tablewright.operators import merge, truth
from tablewright.plans.queries import QUERIES

SF = "/root/testdata/sf0.001"
CLAIM = "run string, entity string, field string, seq int, value string, url string, domain string, support double"


@pytest.mark.parametrize("name", ["kbt_probs", "kbt_winner", "conflicts_resolved", "export_rows", "records_of_run"])
def test_claims_are_shuffled_twice(spark, name):
    """Once to number the rows of a line, once by run and entity."""
    plan = QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert (plan.count("Exchange hashpartitioning"), plan.count("lineitem")) == (2, 1)


def test_alike_values_stay_equal(spark):
    """Two values with the same counts of votes in other orders: neither gains from a last bit in ten rounds, so the earliest claim wins."""
    rng = random.Random(31)
    rows = []
    for e in range(120):
        counts, claims = [rng.randrange(1, 9) for _ in range(rng.randrange(3, 8))], []
        for value in "ab":
            for i, n in enumerate(rng.sample(counts, len(counts))):
                claims += [(value, f"{value}{i}", k) for k in range(n)]
        rng.shuffle(claims)
        rows += [("r", f"e{e}", "f", seq, value, f"u{domain}-{k}", domain, 0.5) for seq, (value, domain, k) in enumerate(claims)]
    df = spark.createDataFrame(rows, CLAIM)
    probs = truth.value_probabilities(truth.voters(df)).collect()
    assert len(probs) == 240 and {r["prob"] for r in probs} == {0.5}
    first = {r[1]: (r[4], r[5], 0.5) for r in reversed(rows)}
    assert {r["entity"]: (r["value"], r["url"], r["prob"]) for r in truth.winners(df).collect()} == first


def cells(spark, seed):
    rng = random.Random(seed)
    rows = [(rng.choice("rs"), f"e{i % 60}", rng.choice("fg"), i, rng.choice(["1", "2", "2.5", "x", "X ", "", None]), u := f"u{rng.randrange(9)}", f"d{int(u[1]) % 4}", rng.choice([None, 0.2, 0.9])) for i in range(900)]
    return rows, spark.createDataFrame(rows, CLAIM)


def test_one_pass_resolves_alike(spark):
    _, df = cells(spark, 32)
    for numeric in (None, ["f"]):
        one, two = truth.resolved_records(df, numeric), truth.resolve(merge.upsert_records(df), df, numeric)
        assert one.columns == two.columns and sorted(map(str, one.collect())) == sorted(map(str, two.collect())) and one.where("resolved").count() > 10


def test_found_counts_claims_without_a_value(spark):
    rows, df = cells(spark, 33)
    first = {}
    for r in rows:
        first.setdefault((r[0], r[1]), r[3])
    got = {(r["run"], r["entity"]): r["found"] for r in merge.records(merge.upsert_records(df, found=True)).collect()}
    assert got and all(first[k] == v for k, v in got.items()) and any(not r[4] and got.get((r[0], r[1])) == r[3] for r in rows)


def test_export_of_entities_without_a_field(spark):
    rows = [("r", "e", "f", "1", "b", [], True), ("r", "e", "g", None, "", [("u", "x")], False), ("r", None, "h", "3", "a", [], True)]
    df = spark.createDataFrame(rows, "run string, entity string, field string, value string, url string, conflicts array<struct<url:string,value:string>>, verified boolean")
    got = {r["entity"]: tuple(r)[2:] for r in merge.export_rows(df, ["f", "g", "k"]).collect()}
    assert got == {"e": ("1", "", "", 0.33, "b", "yes"), None: ("", "", "", 0.33, "a", "")}
