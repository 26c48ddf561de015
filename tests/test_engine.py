"""A whole request over a few pages, its reads, the sinks and the streams."""

import csv
import glob
import json

import pytest
from pyspark.sql import functions as F

from tablewright.operators import coverage
from tablewright.plans.engine import DataSpec, FieldSpec, run
from tablewright.sources import sinks
from tablewright.sources.providers import PatternExtract, StaticFetch, StaticSearch
from tablewright.streaming.coverage import DELTAS, event_stream, running_estimate, session_counts, watch_coverage, windowed_counts

PAGES = [
    ("https://a.example.com/1", "open data prize", "<p>Prize: Open Data Award. Amount: 2 million. Date: 10 July 2025</p>"),
    ("https://b.example.org/2", "open data award", "<p>Prize: Open Data Award. Amount: 2000000. Date: July 10, 2025</p>"),
    ("https://c.example.net/3", "open data news", "<p>Prize: Open Data Award. Amount: 3 million. Date: 10 July 2025</p>"),
    ("https://www.linkedin.com/4", "open data", "<p>Prize: Hidden. Amount: 1</p>"),
    ("https://d.example.com/5", "open data misc", "<p>nothing of use</p>"),
]


PATTERNS = {"name": r"Prize: ([A-Z][A-Za-z ]+)", "amount": r"Amount: ([0-9]+(?: million)?)", "date": r"Date: ([A-Za-z0-9 ,]+)"}


def spec(**more):
    return DataSpec("prize award", [FieldSpec("name"), FieldSpec("amount", "number"), FieldSpec("date", "date")], ["open data", "open data award prize"], **more)


@pytest.fixture(scope="module")
def result(spark):
    pages = spark.createDataFrame(PAGES, "url string, title string, html string")
    seen = []
    r = run(spark, spec(), StaticSearch(pages.select("url", "title")), StaticFetch(pages.select("url", "html")), PatternExtract(PATTERNS), "run-1", on_event=lambda kind, data: seen.append((kind, data)))
    r.seen = seen
    return r


def test_records(result):
    cells = {(r["entity"], r["field"]): r for r in result.records.collect()}
    assert set(cells) == {("open data award", f) for f in ("name", "amount", "date")}
    assert cells["open data award", "date"]["value"] == "2025-07-10"
    assert cells["open data award", "amount"]["value"] in ("2000000", "3000000")
    (record,) = result.records_df().collect()
    assert (record["id"], record["fields"]["date"], record["fields_sourced"]) == ("run-1:open data award", "2025-07-10", 1.0)


def test_sources_and_claims(result):
    ledger = {(r["url"], r["capture"]): r for r in result.sources_df().collect()}
    first = {u: r for (u, c), r in ledger.items() if c == "run-1-capture-1"}
    assert first["https://www.linkedin.com/4"]["status"] == "skipped" and "deny list" in first["https://www.linkedin.com/4"]["reason"]
    assert first["https://a.example.com/1"]["status"] == "ok" and first["https://d.example.com/5"]["status"] == "skipped"
    assert sum(r["records_found"] for r in first.values()) >= 1 and all(r["records_found"] == 0 for (_, c), r in ledger.items() if c == "run-1-capture-2")
    assert result.claims_df("open data award", "date").count() > 0 and result.claims_df("other").count() == 0
    assert result.claims.where("verified").count() == result.claims.count()
    seqs = [(r["capture"], r["seq"]) for r in result.claims_df().collect()]
    assert seqs == sorted(seqs) and len({s for _, s in seqs}) == len(seqs)


def test_captures_counters_and_events(spark, result):
    assert [(r["n"], r["query"]) for r in result.captures_df().collect()] == [(1, "open data"), (2, "open data award prize")]
    stats = result.stats
    assert result.status == "done" and stats["captures_run"] == 2 and stats["records_after_dedupe"] == 1 and len(stats) == 15
    assert stats["urls_skipped_compliance"] == 2 and stats["pages_failed"] == 0 and stats["chunks_gated"] >= 1
    kinds = [k for k, _ in result.seen]
    assert kinds[0] == "status_change" and kinds.count("capture_start") == 2 and kinds.count("record_found") == 2 and kinds[-1] == "status_change"
    assert [r["type"] for r in result.events_df().collect()] == kinds
    (row,) = result.store.runs_df().collect()
    assert (row["run"], row["status"], row["records"]) == ("run-1", "done", 1) and json.loads(row["stats"])["captures_run"] == 2
    q = result.store.events_stream("run-1").writeStream.format("memory").queryName("told").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("told").count() == len(kinds)


def test_accuracy_and_labels(spark, result):
    assert result.accuracy().first()["n_labeled"] == 0
    one = result.claims.select("seq").first()[0]
    label = lambda correct, seq: spark.createDataFrame([(one, correct, "h", seq, "2025-01-01")], "claim_id long, correct int, labeler string, seq int, created_at string")
    result.add_labels(label(0, 1))
    result.add_labels(label(1, 2))
    assert [r["correct"] for r in result.labels_df().collect()] == [1] and result.accuracy().first()["n_labeled"] == 1
    assert result.coverage().first()["s_obs"] == 1


def test_export(result, tmp_path):
    result.export_csv(str(tmp_path / "out"))
    rows = [r for f in glob.glob(f"{tmp_path}/out/*.csv") for r in csv.DictReader(open(f))]
    assert len(rows) == 1 and list(rows[0])[-3:] == ["fields_sourced", "sources", "has_conflict"] and {"name", "amount", "date"} <= set(rows[0])


def test_two_runs_filters_robots_matching_and_replan(spark, tmp_path):
    from tablewright.plans.engine import Cancel, Store

    html = [
        ("https://a.org/1", "alpha", "<p>Prize: Hack Wave 2024 open. Amount: 5</p>"),
        ("https://b.org/2", "alpha", "<p>Prize: HackWave open. Amount: 6</p>"),
        ("https://b.org/private", "alpha", "<p>Prize: Secret One open. Amount: 7</p>"),
        ("https://c.org/l?page=1", "beta", "<p>Prize: Late One open. Amount: 1</p>"),
        ("https://c.org/l?page=2", "gamma", "<p>Prize: Later One open. Amount: 2</p>"),
        ("https://d.org/9", "beta", "<p>Prize: Closed One. Amount: 9</p>"),
    ]
    pages = spark.createDataFrame(html, "url string, title string, html string")
    robots = spark.createDataFrame([("b.org", "User-agent: *\nDisallow: /private", 200)], "domain string, body string, status int")
    asked = DataSpec("prize", [FieldSpec("name"), FieldSpec("amount", "number")], ["alpha"], filters=["open"], target_coverage=1.0)
    extract = PatternExtract({"name": r"Prize: ([A-Z][A-Za-z0-9 ]+?)(?: open)?\.", "amount": r"Amount: ([0-9]+)"})
    store = Store(spark, f"file://{tmp_path}/store")
    search, fetch = StaticSearch(pages.select("url", "title")), StaticFetch(pages.select("url", "html"))
    more = lambda spec, tried, found: ["alpha", "beta"]
    one = run(spark, asked, {"ddg": search, "brave": search}, fetch, extract, "one", store=store, robots=robots, replan=more)
    # The second capture finds nothing new, so the plan is asked for new queries; the one that was tried is left out.
    assert [(r["query"], r["engine"]) for r in one.captures_df().collect()][:3] == [("alpha", "ddg"), ("alpha", "brave"), ("beta", "ddg")]
    assert {r["entity"] for r in one.claims.select("entity").distinct().collect()} == {"hack wave 2024", "late one", "later one"}
    refused = one.sources_df().where("reason = 'disallowed by robots.txt'").select("url").distinct().collect()
    assert [r["url"] for r in refused] == ["https://b.org/private"] and one.stats["records_dropped"] >= 1
    amounts = {r["entity"]: (r["value"], r["url"], [c["value"] for c in r["conflicts"]]) for r in one.records.where("field = 'amount'").collect()}
    assert amounts["hack wave 2024"][0] in ("5", "6") and amounts["late one"] == ("1", "https://c.org/l?page=1", [])
    two = run(spark, asked, search, fetch, extract, "two", store=store, max_captures=1)
    assert {r["entity"] for r in two.claims.select("entity").distinct().collect()} == {"hack wave 2024", "secret one"}
    assert {r["run"]: r["records"] for r in store.runs_df().collect()} == {"one": 3, "two": 2}
    assert one.claims.select("entity").distinct().count() == 3
    stopped = Cancel()
    stopped.cancel()
    three = run(spark, asked, search, fetch, extract, "three", store=store, cancel=stopped)
    assert three.status == "cancelled" and three.stats["captures_run"] == 0 and "three" not in spark.getTags() and not spark.getTags()


def test_a_run_that_finds_nothing_fails(spark):
    pages = spark.createDataFrame(PAGES[:1], "url string, title string, html string")
    none = StaticFetch(pages.select("url", "html").limit(0))
    r = run(spark, spec(), StaticSearch(pages.select("url", "title")), none, PatternExtract(PATTERNS), max_captures=1)
    assert r.status == "failed" and r.error == "no pages could be fetched" and r.stats["pages_failed"] == 1


def test_spec():
    one = DataSpec("x", [FieldSpec("a", "number"), FieldSpec("b")], ["q"])
    assert one.primary == "a" and one.schema()["a"].dataType.typeName() == "double" and one.schema()["a"].metadata["primary"]
    for wrong in (lambda: DataSpec("x", [], []), lambda: DataSpec("x", [FieldSpec("a")], [], target_count=0)):
        with pytest.raises(ValueError):
            wrong()


def test_sinks(spark, tmp_path):
    rows = spark.createDataFrame([("r1", 1, "x"), ("r2", 2, "y")], "run string, id int, v string")
    sinks.append(rows, f"{tmp_path}/t")
    sinks.append(rows.limit(1), f"{tmp_path}/t")
    assert spark.read.parquet(f"{tmp_path}/t").count() == 3
    new = sinks.overwrite_columns(rows, spark.createDataFrame([(2, None)], "id int, v string"), "id")
    assert {r["id"]: r["v"] for r in new.collect()} == {1: "x", 2: None}
    sinks.write_json(rows, f"{tmp_path}/j")
    assert sorted(json.loads(x)["id"] for f in glob.glob(f"{tmp_path}/j/*.txt") for x in open(f)) == [1, 2]
    (tmp_path / "bad.json").write_text("{")
    assert sinks.read_json(spark, str(tmp_path / "bad.json"), "id int").where("id IS NOT NULL").count() == 0


def test_stream_of_captures_stops(spark, tmp_path):
    rows = spark.createDataFrame([(f"e{i % 7}", i % 5) for i in range(60)], "entity string, occasion int")
    rows.repartition(6).write.parquet(f"{tmp_path}/in")
    stream = event_stream(spark, f"{tmp_path}/in", rows.schema)
    seen = []
    watch_coverage(stream, f"{tmp_path}/all", lambda n, e: bool(seen.append(e.first()["s_obs"])), f"{tmp_path}/c1").awaitTermination()
    assert len(seen) == 6 and seen[-1] == 7 and running_estimate(spark.read.schema(DELTAS).parquet(f"{tmp_path}/all")).first() == coverage.estimate(rows).first()
    assert spark.read.parquet(f"{tmp_path}/all").count() == 6  # a row for each batch, however many detections


def test_event_windows(spark, tmp_path):
    rows = spark.createDataFrame([("2025-01-01 10:00:00", 1, "a", 2.0), ("2025-01-01 10:59:00", 1, "a", 3.0), ("2025-01-01 12:00:00", 2, "b", 1.0)], "t string, user_id int, event_type string, value double").select(F.to_timestamp("t").alias("ts"), "user_id", "event_type", "value")
    rows.write.parquet(f"{tmp_path}/e")
    for k, (make, want) in enumerate(((windowed_counts, [("a", 2, 5.0), ("b", 1, 1.0)]), (session_counts, None))):
        q = make(event_stream(spark, f"{tmp_path}/e", rows.schema)).writeStream.outputMode("complete" if k == 0 else "append").format("memory").queryName(f"w{k}").option("checkpointLocation", f"{tmp_path}/w{k}").trigger(availableNow=True).start()
        q.awaitTermination()
        got = spark.table(f"w{k}")
        if want:
            assert sorted((r["event_type"], r["n"], r["total"]) for r in got.collect()) == want
        else:
            assert got.count() <= 3
