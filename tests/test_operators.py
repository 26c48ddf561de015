"""Closed forms against step-by-step versions, and edge tables."""

import math
import random
from collections import defaultdict

from pyspark.sql import functions as F

from tablewright.operators import audit, coverage, entity, gates, merge, truth


def fold(claims):
    """The merge as a loop over the claims of one cell."""
    state = None
    for seq, value, url in claims:
        if not value:
            continue
        if state is None:
            state = {"value": value, "url": url, "by": None, "conflicts": []}
        elif state["url"] and state["url"] != url:
            if state["value"].lower() == value.lower():
                state = {"value": value, "url": url, "by": state["url"], "conflicts": []}
            else:
                state["conflicts"].append((url, value))
    return state


def test_merge_equals_the_fold(spark):
    rng = random.Random(5)
    cells = {f"e{i}": [(k, rng.choice(["a", "A", "b", "c", "", None]), rng.choice(["u1", "u2", "u3"])) for k in range(rng.randrange(1, 9))] for i in range(300)}
    rows = [(e, "f", s, v, u) for e, cs in cells.items() for s, v, u in cs]
    df = spark.createDataFrame(rows, "entity string, field string, seq int, value string, url string")
    got = {r["entity"]: r for r in merge.upsert_records(df).collect()}
    for e, cs in cells.items():
        want = fold(cs)
        if want is None:
            assert e not in got
        else:
            r = got[e]
            assert (r["value"], r["url"], r["corroborated_by"], [tuple(c) for c in r["conflicts"]]) == (want["value"], want["url"], want["by"], want["conflicts"]), cs


def kbt(claims):
    """Trust iteration of one cell in plain Python: value -> probability."""
    best = {}
    for c in sorted(claims, key=lambda c: c[0]):
        if c[2] not in best or (c[4] or 0) > (best[c[2]][4] or 0):
            best[c[2]] = c
    by = defaultdict(list)
    for c in best.values():
        by[c[1]].append(c[3])
    if len(by) < 2:
        return dict.fromkeys(by, 1.0)
    trust = {d: 0.8 for ds in by.values() for d in ds}
    for _ in range(10):
        score = {v: sum(math.log(min(max(trust[d], 0.01), 0.99) / (1 - min(max(trust[d], 0.01), 0.99))) for d in ds) for v, ds in by.items()}
        top = max(score.values())
        total = sum(math.exp(s - top) for s in score.values())
        p = {v: math.exp(s - top) / total for v, s in score.items()}
        trust = {d: (lambda x: sum(x) / len(x))([p[v] for v, ds in by.items() for e in ds if e == d]) for d in trust}
    return p


def test_trust_equals_plain_iteration(spark):
    rng = random.Random(6)
    cells = {f"e{i}": [(k, rng.choice("abc"), f"u{rng.randrange(6)}", f"d{rng.randrange(4)}", rng.choice([None, 0.2, 0.9])) for k in range(rng.randrange(1, 10))] for i in range(60)}
    # A URL has one domain.
    cells = {e: [(s, v, u, f"d{int(u[1]) % 4}", x) for s, v, u, _, x in cs] for e, cs in cells.items()}
    df = spark.createDataFrame([(e, "f", *c) for e, cs in cells.items() for c in cs], "entity string, field string, seq int, value string, url string, domain string, support double")
    got = defaultdict(dict)
    for r in truth.value_probabilities(truth.voters(df)).collect():
        got[r["entity"]][r["v"]] = r["prob"]
    for e, cs in cells.items():
        want = kbt(cs)
        assert got[e].keys() == want.keys() and all(abs(got[e][v] - want[v]) < 1e-9 for v in want)


def test_one_vote_for_each_url(spark):
    df = spark.createDataFrame([("e", "f", 1, "old", "u", "d", 0.5), ("e", "f", 2, "new", "u", "d", 0.9), ("e", "f", 3, "older", "u", "d", 0.5)], "entity string, field string, seq int, value string, url string, domain string, support double")
    (w,) = truth.winners(df).collect()
    assert (w["value"], w["prob"]) == ("new", 1.0)


def incidence(spark, pairs):
    return spark.createDataFrame(pairs, "entity string, occasion int")


def test_coverage_edges(spark):
    assert coverage.estimate(incidence(spark, [])).first()["s_hat"] == 0
    assert coverage.estimate(incidence(spark, [("a", 1), ("b", 1)])).first()["s_hat"] == 2
    r = coverage.estimate(incidence(spark, [("a", 1), ("b", 2), ("c", 2), ("c", 1), ("a", 1)])).first()
    assert (r["s_obs"], r["q1"], r["q2"], r["t"]) == (3, 2, 1, 2) and abs(r["s_hat"] - (3 + 0.5 * 2 / 4)) < 1e-12


def test_trajectory_ends_at_the_estimate(spark):
    rng = random.Random(7)
    i = incidence(spark, [(f"e{rng.randrange(40)}", rng.randrange(8)) for _ in range(150)])
    last, whole = coverage.trajectory(i).orderBy(F.col("t").desc()).first(), coverage.estimate(i).first()
    assert all(last[c] == whole[c] for c in ("s_obs", "q1", "q2", "s_hat"))


def test_ppi_edges(spark):
    scores = spark.createDataFrame([(1, 0.5), (2, None)], "id int, score double")
    r = audit.ppi_accuracy(scores).first()
    assert (r["theta_hat"], r["se"], r["n_labeled"]) == (0.5, 0.0, 0)
    r = audit.ppi_accuracy(scores, spark.createDataFrame([(1, 1)], "id int, correct int")).first()
    assert (r["theta_hat"], r["n_labeled"]) == (1.0, 1)
    assert audit.ppi_accuracy(scores.limit(0)).first()["n_cells"] == 0


def test_conformal_without_a_threshold(spark):
    assert audit.conformal_threshold(spark.createDataFrame([(0.9, 1)], "score double, correct int")).first()["tau"] == 1.0


def test_conformal_threshold_of_many_scores(spark):
    rng = random.Random(14)
    rows = [(rng.choice([rng.random(), 1.0, 1.5, -0.2, round(rng.random(), 1)]), 0) if rng.random() < 0.02 else (rng.random() ** 0.5, 1) for _ in range(3000)] + [(None, 0)] * 5
    df = spark.createDataFrame(rows, "score double, correct int")
    by = sorted({s for s, _ in rows if s is not None}, reverse=True)
    good = []
    for s in by:
        n, wrong = sum(x is not None and x >= s for x, _ in rows), sum(x is not None and x >= s and not c for x, c in rows)
        if wrong / n + math.sqrt(math.log(10) / (2 * n)) <= 0.06:
            good.append(s)
    for lowest, pick in ((False, max), (True, min)):
        r = audit.conformal_threshold(df, alpha=0.06, lowest=lowest).first()
        assert (r["tau"], r["n_qualifying"]) == (pick(good), len(good)) and len(good) > 100


def test_matching_of_editions(spark):
    keys = spark.createDataFrame([("hackwave 2024", 1), ("hackwave 2025", 2), ("hack wave", 3), ("qwen2 5 vl", 4), ("qwen 2 5 vl 2025", 5), ("other", 6)], "key string, seq int")
    got = {r["key"]: r["canonical"] for r in entity.match_existing_key(keys).collect()}
    assert got == {"hackwave 2024": "hackwave 2024", "hackwave 2025": "hackwave 2025", "hack wave": "hackwave 2024", "qwen2 5 vl": "qwen2 5 vl", "qwen 2 5 vl 2025": "qwen2 5 vl", "other": "other"}


def test_gates_without_scores(spark):
    rows = spark.createDataFrame([(1, None), (2, 0.34), (3, 0.35)], "id int, p double")
    assert sorted(r["id"] for r in gates.page_gate(rows).collect()) == [1, 3]
    rows = spark.createDataFrame([(1, None), (2, []), (3, [0.1, 0.9]), (4, [0.3, 0.9]), (5, [None])], "id int, p array<double>")
    assert {r["id"]: r["filter_uncertain"] for r in gates.filter_gate(rows).collect()} == {1: False, 2: False, 4: True, 5: False}


def test_ledger_keeps_the_first_status(spark):
    rows = spark.createDataFrame([("r", "c", "u", "skipped", 1), ("r", "c", "u", "ok", 2)], "run string, capture string, url string, status string, seq int")
    (r,) = merge.source_ledger(rows).collect()
    assert (r["status"], r["status_final"]) == ("skipped", "ok")


def test_runs_are_kept_apart(spark):
    claims = spark.createDataFrame([("r1", "e", "f", 1, "a", "u1", "d1", 0.5), ("r2", "e", "f", 2, "b", "u2", "d2", 0.5), ("r2", "e", "f", 3, "b", "u3", "d3", 0.5)], "run string, entity string, field string, seq int, value string, url string, domain string, support double")
    got = {r["run"]: (r["value"], r["url"], r["corroborated_by"], r["conflicts"]) for r in merge.upsert_records(claims).collect()}
    assert got == {"r1": ("a", "u1", None, []), "r2": ("b", "u3", "u2", [])}
    assert {r["run"]: r["n_claims"] for r in truth.winners(claims).collect()} == {"r1": 1, "r2": 2}


def test_numbers_stay_numbers_when_resolved(spark):
    schema = "run string, entity string, field string, seq int, value string, url string, domain string, support double"
    claims = spark.createDataFrame([("r3", "m", "params", 1, "7B", "u1", "d", 0.2), ("r3", "m", "params", 2, "8 billion", "u1", "d", 0.9), ("r3", "n", "params", 1, "5", "u1", "d", 0.2), ("r3", "n", "params", 2, "five", "u1", "d", 0.9)], schema)
    cells = spark.createDataFrame([("r3", k, "params", v, "u1", [("u2", "x")]) for k, v in (("m", "7000000000"), ("n", "5"))], "run string, entity string, field string, value string, url string, conflicts array<struct<url:string,value:string>>")
    got = {r["entity"]: (r["value"], r["resolved"]) for r in truth.resolve(cells, claims, numeric=["params"]).collect()}
    assert got == {"m": ("8000000000", True), "n": ("5", False)}
    as_text = {r["entity"]: (r["value"], r["resolved"]) for r in truth.resolve(cells, claims).collect()}
    assert as_text == {"m": ("8 billion", True), "n": ("five", True)}


def test_stop_waits_for_the_lower_bound(spark):
    rows = [(1, 5, 5, 1.0), (2, 3, 8, 0.4), (3, 3, 11, 0.79), (4, 3, 14, 0.8), (5, 0, 14, 0.7)]
    steps = spark.createDataFrame(rows, "t int, new_entities int, s_obs int, coverage_lo double").withColumn("s_hat", F.col("s_obs").cast("double"))
    assert [r["stop"] for r in coverage.stop_capture(steps).orderBy("t").collect()] == [False, False, False, True, False]
    pairs = [(f"e{k}", t) for k in range(6) for t in range(1, 5) if (k + t) % 2 == 0 or k < 3]
    last = coverage.trajectory_bounds(incidence(spark, pairs)).where("t = 4").first()
    whole = coverage.summary(incidence(spark, pairs)).first()
    assert (last["ci_lo"], last["ci_hi"], last["coverage_lo"]) == (whole["ci_lo_s"], whole["ci_hi_s"], whole["coverage_lo"])


def test_ledger_tells_captures_with_equal_ends_apart(spark):
    rows = spark.createDataFrame([("r", "a-12345678", "u", "ok", 1), ("r", "b-12345678", "u", "ok", 2), ("r", "", "u", "ok", 3), ("r", None, "u", "ok", 4)], "run string, capture string, url string, status string, seq int")
    assert merge.source_ledger(rows).count() == 4
