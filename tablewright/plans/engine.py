"""A request from queries to merged records: plan, search, comply, fetch, gate, extract, verify, estimate, replan, stop, merge, resolve.

The loop runs on the driver and has a dozen steps at most; each step's work is a plan over tables. What a step finds is appended to the run's tables in
a store (a folder that all executors see), so later steps and readers read files and no lineage grows.
"""

from __future__ import annotations

import json
import threading
import time
import uuid
from collections.abc import Callable
from contextlib import contextmanager
from dataclasses import dataclass, field

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import canonical_domain, chunks, norm_value, normalize_name, normalize_value, relax_query, single_year, url_domain
from ..functions.web import compliance_reason, robots_allow
from ..operators import audit, coverage, entity, gates, merge, planner, truth
from ..sources.providers import Extract, Fetch, Judge, LexicalJudge, Search
from ..sources.sinks import write_csv
from ..storage import checkpointed

#: Longest run of captures, new plans, and captures before a stop.
MAX_CAPTURES, MAX_REPLANS = planner.MAX_CAPTURES, 2
AGENT = "tablewright"

# A claim's place: capture, place among its URLs, page and chunk, record in the chunk, field. Each has room in one number.
_FIELDS, _RECORDS, _CHUNKS, _URLS = 100, 10_000, 1_000_000, 100


@dataclass(frozen=True)
class FieldSpec:
    name: str
    type: str = "string"
    description: str = ""
    required: bool = False


@dataclass(frozen=True)
class DataSpec:
    entity: str
    fields: list[FieldSpec]
    search_queries: list[str]
    filters: list[str] = field(default_factory=list)
    summary: str = ""
    target_count: int = 20
    target_coverage: float = 0.8

    def __post_init__(self) -> None:
        if not self.fields or not 1 <= self.target_count <= 200 or not 0 <= self.target_coverage <= 1:
            raise ValueError("a spec needs fields, 1 to 200 rows and a coverage from 0 to 1")

    @property
    def primary(self) -> str:
        return self.fields[0].name

    def schema(self) -> T.StructType:
        """What an extraction returns: values and their evidence, all nullable."""
        kinds = {"number": T.DoubleType(), "boolean": T.BooleanType()}
        meta = lambda i, f: {"description": f.description, "required": f.required, "primary": i == 0}
        values = [T.StructField(f.name, kinds.get(f.type, T.StringType()), True, meta(i, f)) for i, f in enumerate(self.fields)]
        return T.StructType([*values, T.StructField("evidence", T.StructType([T.StructField(f.name, T.StringType()) for f in self.fields]))])


#: Columns of the store's tables. A run's rows are one partition of each.
TABLES = {
    "captures": "run string, capture string, n int, query string, engine string, source_type string, seq long",
    "claims": "run string, name_key string, field string, seq long, value string, raw_value string, value_norm string, url string, domain string, capture string, evidence string, verified boolean, support double, filter_uncertain boolean",
    "sources": "run string, capture string, url string, domain string, status string, reason string, records_found long, seq long",
    "gates": "run string, capture string, chunks long, gated long, dropped long",
    "events": "run string, seq long, type string, payload string",
    "runs": "run string, entity string, spec string, status string, error string, stats string, seq long",
}


class Store:
    """The tables of all runs under one folder."""

    def __init__(self, spark: SparkSession, path: str | None = None):
        self.spark = spark
        self.path = path or f"{checkpointed(spark).rstrip('/')}/tablewright/store-{uuid.uuid4().hex}"

    def read(self, name: str, run: str | None = None) -> DataFrame:
        try:
            rows = self.spark.read.schema(TABLES[name]).parquet(f"{self.path}/{name}")
        except AnalysisException:  # nothing was written yet
            rows = self.spark.createDataFrame([], TABLES[name])
        return rows if run is None else rows.where(F.col("run") == run)

    def append(self, name: str, rows: DataFrame) -> None:
        columns = [c.split()[0] for c in TABLES[name].split(", ")]
        rows.select(*columns).write.mode("append").partitionBy("run").parquet(f"{self.path}/{name}")

    def append_rows(self, name: str, *rows: tuple) -> None:
        self.append(name, self.spark.createDataFrame(list(rows), TABLES[name]).coalesce(1))

    def runs_df(self) -> DataFrame:
        """The last state of each run, newest first, with the number of its records."""
        last = self.read("runs").groupBy("run").agg(F.max(F.struct("seq", "entity", "spec", "status", "error", "stats")).alias("r"), F.min("seq").alias("created"))
        keys = matched_claims(self.read("claims")).select("run", "entity").distinct().groupBy("run").agg(F.count("*").alias("records"))
        return last.select("run", "created", "r.entity", "r.spec", "r.status", "r.error", "r.stats").join(keys, "run", "left").na.fill(0, ["records"]).orderBy(F.col("created").desc())

    def events_stream(self, run: str | None = None) -> DataFrame:
        """The typed progress events as a stream: ``run, seq, type, payload``."""
        rows = self.spark.readStream.schema(TABLES["events"]).parquet(f"{self.path}/events")
        return rows if run is None else rows.where(F.col("run") == run)


def matched_claims(claims: DataFrame) -> DataFrame:
    """Claims with ``entity``: the earliest key of the run that names the same entity as the claim's own."""
    keys = claims.select("run", F.col("name_key").alias("key"), "seq")
    return claims.join(entity.match_existing_key(keys).withColumnRenamed("key", "name_key").withColumnRenamed("canonical", "entity"), ["run", "name_key"])


@dataclass
class RunResult:
    """A run's tables, and the reads that a client asks for."""

    spec: DataSpec
    run: str
    store: Store
    status: str
    error: str | None
    stats: dict

    @property
    def claims(self) -> DataFrame:
        return matched_claims(self.store.read("claims", self.run))

    @property
    def records(self) -> DataFrame:
        numeric = [f.name for f in self.spec.fields if f.type == "number"]
        return truth.resolved_records(self.claims, numeric)

    @property
    def incidence(self) -> DataFrame:
        return self.claims.where(F.col("field") == self.spec.primary).select("entity", F.col("capture").alias("occasion")).distinct()

    def records_df(self) -> DataFrame:
        """Records in the order in which they were found."""
        found = self.claims.groupBy("run", "entity").agg(F.min("seq").alias("found"))
        return merge.records(self.records, [f.name for f in self.spec.fields]).join(found, ["run", "entity"]).orderBy("found")

    def captures_df(self) -> DataFrame:
        return self.store.read("captures", self.run).orderBy("seq")

    def sources_df(self) -> DataFrame:
        """The ledger: each page visit of each capture, the first status of a page and its last one."""
        return merge.source_ledger(self.store.read("sources", self.run)).orderBy("seq", "url")

    def claims_df(self, entity: str | None = None, name: str | None = None) -> DataFrame:
        rows = self.claims
        for column, value in (("entity", entity), ("field", name)):
            rows = rows.where(F.col(column) == value) if value is not None else rows
        return rows.orderBy("seq")

    def events_df(self) -> DataFrame:
        return self.store.read("events", self.run).orderBy("seq")

    labels: DataFrame | None = None

    def add_labels(self, labels: DataFrame) -> None:
        """Judgements ``claim_id, correct, labeler, seq, created_at``; a later one of a claim replaces it."""
        self.labels = merge.label_upsert(labels if self.labels is None else self.labels.withColumn("seq", F.lit(-1)).unionByName(labels, allowMissingColumns=True))

    def labels_df(self) -> DataFrame | None:
        return self.labels

    def accuracy(self) -> DataFrame:
        """Prediction-powered accuracy of this run's claims."""
        scores = self.claims.select(F.col("seq").alias("id"), F.col("support").alias("score"))
        return audit.ppi_accuracy(scores, None if self.labels is None else self.labels.select(F.col("claim_id").alias("id"), "correct"))

    def coverage(self) -> DataFrame:
        return coverage.summary(self.incidence)

    def export_rows(self) -> DataFrame:
        return merge.export_rows(self.records, [f.name for f in self.spec.fields]).drop("run")

    def export_csv(self, path: str) -> None:
        write_csv(self.export_rows(), path)


class Cancel:
    """A request to stop: no new capture begins, and the jobs of the running one end."""

    def __init__(self) -> None:
        self._flag = threading.Event()
        self._end: Callable[[], object] | None = None

    def cancel(self) -> None:
        self._flag.set()
        if self._end:
            self._end()

    def __bool__(self) -> bool:
        return self._flag.is_set()


@contextmanager
def _tagged(spark: SparkSession, tag: str, cancel: Cancel):
    """Jobs of the block carry a tag of the run, by which they can be ended; it is taken off again."""
    spark.addTag(tag)
    cancel._end = lambda: spark.interruptTag(tag)
    try:
        yield
    finally:
        cancel._end = None
        spark.removeTag(tag)


def search_step(spark: SparkSession, engines: dict[str, Search], engine: str, query: str) -> DataFrame:
    """``capture, rank, url``: results of one query on one engine, those of its relaxed form added where they are few. An engine that is not configured falls back to the first."""
    provider = engines.get(engine, next(iter(engines.values())))
    asked = spark.createDataFrame([(query,)], "query string")
    strict = provider.results(asked).select("query", "rank", "url")
    loose = asked.select(F.col("query").alias("asked"), relax_query(F.col("query")).alias("query")).where("query <> asked AND query <> ''")
    more = provider.results(loose.select("query")).select("query", "rank", "url").join(loose, "query").select(F.col("asked").alias("query"), "rank", "url")
    return planner.relaxed(strict, more).withColumnRenamed("query", "capture")


def comply(urls: DataFrame, robots: DataFrame | None = None, agent: str = AGENT) -> DataFrame:
    """``urls`` with ``reason``, empty where a URL may be fetched: shape, deny list, destination, then the site's ``robots(domain, body, status)``. The first reason counts."""
    judged = urls.withColumn("reason", compliance_reason(F.col("url")))
    if robots is None:
        return judged
    files = robots.select(F.col("domain").alias("__d"), "body", F.col("status").alias("__status"))
    met = judged.withColumn("__k", canonical_domain(F.col("url"))).join(files, F.col("__k") == F.col("__d"), "left")
    refused = (F.col("reason") == "") & ~robots_allow("body", "__status", "url", F.lit(agent))
    return met.withColumn("reason", F.when(refused, "disallowed by robots.txt").otherwise(F.col("reason"))).drop("__k", "__d", "body", "__status")


def read_pages(spec: DataSpec, pages: DataFrame, extract: Extract, judge: Judge, year: int | None) -> tuple[DataFrame, DataFrame]:
    """Cells of the pages ``rank, url, page_no, text`` that pass the gates, and ``url, chunks, gated, dropped`` counts."""
    pieces = pages.select("rank", "url", "page_no", F.posexplode(chunks(F.col("text"))).alias("pos", "text")).withColumn("p", judge.page(spec, F.col("text")))
    marked = pieces.withColumn("pos", F.col("page_no") * 10_000 + F.col("pos")).withColumn("passes", F.coalesce("p", F.lit(1.0)) >= gates.PAGE_GATE)
    rows = extract.cells(gates.page_gate(marked)).withColumn("page", F.col("text"))
    rows = rows.withColumn("record", F.lit(0)) if "record" not in rows.columns else rows
    named = gates.has_primary(rows, "entity").withColumn("p", judge.filters(spec, F.col("text")))
    kept = gates.verify(gates.filter_gate(named))
    kinds = F.create_map(*(F.lit(x) for f in spec.fields for x in (f.name, f.type)))
    hint = F.coalesce(single_year(F.col("evidence")), F.lit(year).cast("int"))
    cells = kept.withColumn("raw_value", F.col("value")).withColumn("value", normalize_value(F.col("raw_value"), kinds[F.col("field")], hint))
    cells = cells.withColumn("value_norm", norm_value(F.col("value"), kinds[F.col("field")]))
    cells = gates.claim_plan(cells).withColumn("support", gates.support(judge.support(F.col("raw_value"), F.col("evidence"))))
    dropped = named.select("url", "pos", "record", "p").distinct().withColumn("low", F.coalesce(F.array_min(F.transform("p", lambda x: F.coalesce(x, F.lit(gates.NEUTRAL)))) < gates.FILTER_DROP, F.lit(False)))
    counts = marked.groupBy("url").agg(F.count("*").alias("chunks"), F.count_if(~F.col("passes")).alias("gated")).join(dropped.groupBy("url").agg(F.count_if("low").alias("dropped")), "url", "left").na.fill(0, ["dropped"])
    return cells, counts


def _place(capture: int, spec: DataSpec) -> Column:
    number = F.create_map(*(F.lit(x) for i, f in enumerate(spec.fields) for x in (f.name, i)))
    at = F.lit(capture).cast("long") * _URLS + F.col("rank")
    return ((at * _CHUNKS + F.col("pos")) * _RECORDS + F.col("record")) * _FIELDS + number[F.col("field")]


def run(
    spark: SparkSession, spec: DataSpec, search: Search | dict[str, Search], fetch: Fetch, extract: Extract, name: str | None = None, *,
    store: Store | None = None, judge: Judge | None = None, robots: DataFrame | None = None, replan: Callable[[DataSpec, list[str], list[str]], list[str]] | None = None,
    on_event: Callable[[str, dict], None] | None = None, cancel: Cancel | None = None, max_captures: int = MAX_CAPTURES,
) -> RunResult:
    """The whole request. Captures go on until the interval's lower bound of the coverage meets the target, the yield runs dry, the combinations end, or it is cancelled."""
    engines = search if isinstance(search, dict) else {"default": search}
    store, judge, cancel, name = store or Store(spark), judge or LexicalJudge(), cancel or Cancel(), name or f"run-{uuid.uuid4().hex[:12]}"
    stats: dict = {k: 0 for k in ("urls_discovered", "urls_skipped_compliance", "pages_fetched", "pages_failed", "records_found", "records_after_dedupe", "captures_run", "chunks_gated", "chunks_total", "records_dropped", "conflicts_resolved")} | {k: None for k in ("coverage_estimate", "coverage_ci_low", "coverage_ci_high", "s_hat")}
    told = [time.time_ns()]
    result = RunResult(spec, name, store, "planning", None, stats)

    def tell(kind: str, **payload) -> None:
        told[0] += 1
        store.append_rows("events", (name, told[0], kind, json.dumps(payload)))
        if on_event:
            on_event(kind, payload)

    def enter(status: str, error: str | None = None) -> None:
        told[0] += 1
        result.status, result.error = status, error
        store.append_rows("runs", (name, spec.entity, json.dumps({"fields": [f.name for f in spec.fields], "queries": spec.search_queries}), status, error, json.dumps(stats), told[0]))
        tell("status_change" if error is None else "error", **({"status": status} if error is None else {"message": error}))

    def capture(n: int, query: str, engine: str, kind: str) -> tuple[int, bool]:
        """One step; the number of new entities, and whether nearly all of its chunks were gated."""
        key = f"{name}-capture-{n}"
        told[0] += 1
        store.append_rows("captures", (name, key, n, query, engine, kind, told[0]))
        tell("capture_start", capture_id=key, query=query, engine=engine, source_type=kind)
        known = result.incidence.select("entity").distinct()  # of the files that are there now
        found = planner.top_urls(search_step(spark, engines, engine, query))
        ranked = comply(found.select("url", F.row_number().over(planner.in_order("rank", "url")).alias("rank")), robots)
        urls = ranked.checkpoint()  # six rows
        pages = fetch.pages(urls.where("reason = ''").select("url")).join(urls.select("url", "rank"), "url")
        cells, counts = read_pages(spec, pages, extract, judge, None if not spec.filters else _only_year(spark, spec.filters))
        claims = cells.select(F.lit(name).alias("run"), normalize_name(F.col("entity")).alias("name_key"), "field", _place(n, spec).alias("seq"), "value", "raw_value", "value_norm", "url", url_domain(F.col("url")).alias("domain"), F.lit(key).alias("capture"), "evidence", "verified", "support", "filter_uncertain")
        store.append("claims", claims)
        counts = counts.checkpoint()
        store.append("gates", counts.agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("chunks", "gated", "dropped"))).select(F.lit(name).alias("run"), F.lit(key).alias("capture"), "*"))
        mine = result.claims.where(F.col("capture") == key)
        records = mine.groupBy("url").agg(F.countDistinct(F.expr(f"seq div {_FIELDS}")).alias("n"))
        new = mine.select("url", "entity").distinct().join(known, "entity", "left_anti")
        visits = urls.join(counts, "url", "left").join(new.groupBy("url").agg(F.count("*").alias("records_found")), "url", "left")
        status = F.when(F.col("reason") != "", "skipped").when(F.col("chunks").isNull(), "failed").when(F.col("gated") >= F.col("chunks"), "skipped").otherwise("ok")
        why = F.when(F.col("reason") != "", F.col("reason")).when(F.col("chunks").isNull(), "fetch error or empty page").when(F.col("gated") >= F.col("chunks"), "page gate").otherwise("")
        ledger = visits.select(F.lit(name).alias("run"), F.lit(key).alias("capture"), "url", url_domain(F.col("url")).alias("domain"), status.alias("status"), why.alias("reason"), F.coalesce("records_found", F.lit(0)).cast("long").alias("records_found"), (F.lit(told[0]) + F.col("rank")).alias("seq")).checkpoint()
        store.append("sources", ledger)
        told[0] += 1000
        for r in ledger.orderBy("seq").select("url", "status", "records_found").collect():  # a row for each of six URLs
            tell("source", capture_id=key, **r.asDict())
        by = {r["status"] + r["why"]: r["n"] for r in ledger.groupBy("status", F.when(F.col("reason") == "page gate", "+").otherwise("").alias("why")).agg(F.count("*").alias("n")).collect()}
        totals = counts.agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("chunks", "gated", "dropped"))).first()
        got = records.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()["n"]
        fresh = new.select("entity").distinct().count()
        for k, v in (("captures_run", 1), ("urls_discovered", sum(by.values())), ("urls_skipped_compliance", by.get("skipped", 0)), ("pages_failed", by.get("failed", 0)), ("pages_fetched", by.get("ok", 0) + by.get("skipped+", 0)), ("chunks_total", totals["chunks"]), ("chunks_gated", totals["gated"]), ("records_dropped", totals["dropped"]), ("records_found", got)):
            stats[k] += v
        tell("record_found", capture_id=key, found=got, new=fresh)
        return fresh, totals["chunks"] > 0 and totals["gated"] >= 0.9 * totals["chunks"]

    with _tagged(spark, name, cancel):
        enter("fetching")
        queries, used, yields, replans = list(spec.search_queries), set(), [], 0
        while stats["captures_run"] < max_captures and not cancel:
            combo = next(((q, e, "general") for q in queries for e in engines if (q, e, "general") not in used), None)
            if combo is None:
                break
            used.add(combo)
            fresh, gated = capture(stats["captures_run"] + 1, *combo)
            yields.append(fresh)
            if (fresh == 0 or gated) and replans < MAX_REPLANS and replan and not cancel:
                replans += 1
                tried = {q.strip().lower() for q in queries}
                some = [r[0] for r in result.incidence.select("entity").distinct().orderBy("entity").limit(spec.target_count).collect()]
                more = [q for q in replan(spec, queries, some) if q.strip().lower() not in tried][: planner.MAX_REPLAN_QUERIES]
                queries[queries.index(combo[0]) + 1 : queries.index(combo[0]) + 1] = more
                if more:
                    tell("replan", queries=more)
            if stop(result, yields, tell):
                break
        resolved = result.records.where("resolved").count()
        stats["conflicts_resolved"], stats["records_after_dedupe"] = resolved, result.incidence.select("entity").distinct().count()
        if cancel:
            enter("cancelled")
        elif stats["records_after_dedupe"] == 0:
            enter("failed", "no pages could be fetched" if stats["pages_fetched"] == 0 else "no usable records were found on the fetched pages")
        else:
            enter("done")
    return result


def _only_year(spark: SparkSession, filters: list[str]) -> int | None:
    return spark.createDataFrame([(" ".join(filters),)], "t string").select(single_year(F.col("t"))).first()[0]


def stop(result: RunResult, yields: list[int], tell: Callable[..., None]) -> bool:
    """After a capture: the estimate with its interval, and whether to end. All captures count as occasions, those that found nothing too."""
    spec, stats, t = result.spec, result.stats, result.stats["captures_run"]
    r = coverage.summary(result.incidence).first()
    if t < 2 or r["s_obs"] < 2:
        return False
    stats |= {"coverage_estimate": round(r["coverage_est"], 4), "coverage_ci_low": round(r["coverage_lo"], 4), "coverage_ci_high": round(r["coverage_hi"], 4), "s_hat": round(r["s_hat"], 1)}
    result.stats.update(stats)
    tell("coverage", s_obs=r["s_obs"], s_hat=stats["s_hat"], coverage_est=stats["coverage_estimate"], coverage_lo=stats["coverage_ci_low"], T=t)
    window, mean = yields[-4:], max(1.0, sum(yields) / len(yields))
    enough = t >= coverage.MIN_CAPTURES and r["s_obs"] >= min(spec.target_count, 5)
    dry = len(yields) > 1 and sum(window) / len(window) / mean < coverage.MIN_YIELD and t >= coverage.MIN_CAPTURES + 1
    return (enough and r["coverage_lo"] >= spec.target_coverage) or dry
