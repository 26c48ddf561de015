"""Queries over all rows of their tables: the registered SQL has no row filter either, and small tables show what a filter would lose."""

import hashlib

from compare import differences

from tablewright.plans.oracles import CLAIMS, ORACLES
from tablewright.plans.queries import QUERIES

SF = "/root/testdata/sf0.001"


def test_sql_reads_all_rows():
    assert "WHERE" not in CLAIMS
    for name in ("chao2_estimate", "chao2_events", "bootstrap_ci", "coverage_trajectory", "stop_capture", "stream_coverage", "entity_components", "decode_bytes"):
        assert "o_orderpriority" not in ORACLES[name] and "event_type" not in ORACLES[name] and "%" not in ORACLES[name].split("sd AS")[0].replace("% len(pool)", "") and "substr(text" not in ORACLES[name]


def test_claims_of_a_domain(spark):
    sf = SF.replace("0.001", "0.01")  # the smallest tables have no claim of the wanted domain
    df = QUERIES["claims_filtered"](spark, sf)
    assert df.count() > 0 and not differences(df, ORACLES["claims_filtered"], sf)


def test_components_link_every_supplier(spark, tmp_path):
    rows = [(1, 5, 1), (1, 7, 2), (1, 9, 3), (2, 9, 4), (2, 11, 1), (3, 2, 5), (46, 4, 1), (46, 3, 2), (46, 6, 1)]
    spark.createDataFrame(rows, "l_partkey long, l_suppkey long, l_linenumber int").write.parquet(f"{tmp_path}/lineitem.parquet")
    got = {tuple(r) for r in QUERIES["entity_components"](spark, str(tmp_path)).collect()}
    assert got == {(5, 5), (7, 5), (9, 5), (11, 5), (2, 2), (3, 3), (4, 3), (6, 3)}


def test_premise_is_filled_past_blanks(spark, tmp_path):
    text = "a" + " " * 2000 + "b" * 700
    spark.createDataFrame([(1, text, "en"), (2, text, "en")], "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: r["premise_md5"] for r in QUERIES["premise_hypothesis"](spark, str(tmp_path)).collect()}
    md5 = lambda x: hashlib.md5(x.encode()).hexdigest()
    q = "a " + "b" * 700
    assert got == {1: md5(q[:600]), 2: md5(("b" * 300 + " ... " + q)[:600])}


def test_every_passage_on_every_page(spark, tmp_path):
    long = "One two  three four five six seven eight nine"
    items = [(0, long), (41, "alpha beta gamma delta epsilon zeta eta theta"), (107, "short one"), (150, " "), (199, None)]
    docs = [(0, "x alpha beta gamma delta epsilon zeta eta theta y"), (1, "bone TWO three\nfour five six seven eight nineteen and a short  one"), (1, "another short one"), (None, long), (-7, long + " " + long), (5, "one two three four five six seven eight"), (6, None), (7, "")]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    norm = lambda t: " ".join((t or "").lower().split())
    want = []
    for k, t in docs:
        hits = [i for i, q in items if norm(q) and norm(q) in norm(t)]
        want += [(k, i) for i in hits or [None]]
    got = QUERIES["quote_on_page"](spark, str(tmp_path)).select("doc_id", "item_id").collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want)) and len(want) == 9
