"""Every operator as a query over the driver's tables. Names agree with those in ``oracles``."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions import web
from ..operators import audit, coverage, entity, evaluation, gates, merge, planner, truth
from ..sources import tables as S

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ENGINES = ["ddg", "brave", "searxng"]


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def _scalar(name: str, table: str, key: str, raw: str, function: Callable[[Column], Column]) -> None:
    """A scalar function over one raw value of each row of a table."""

    def run(spark: SparkSession, sf: str) -> DataFrame:
        return S.table(spark, sf, table).select(F.col(key).alias("id"), F.expr(raw).alias("raw")).select("id", "raw", function(F.col("raw")).alias("result"))

    QUERIES[name] = run


_scalar("norm_text", "part", "p_partkey", S.RAW_TEXT, X.norm_text)
_scalar("normalize_name", "part", "p_partkey", S.RAW_NAME, X.normalize_name)
_scalar("compact_key", "part", "p_partkey", S.RAW_NAME, lambda c: X.compact_key(X.normalize_name(c)))
_scalar("normalize_date", "orders", "o_orderkey", S.RAW_DATE, lambda c: X.normalize_date(c, F.lit(2025)))
_scalar("normalize_date_no_hint", "orders", "o_orderkey", S.RAW_DATE, X.normalize_date)
_scalar("normalize_number", "orders", "o_orderkey", S.RAW_NUMBER, X.normalize_number)
_scalar("single_year", "part", "p_partkey", S.RAW_TEXT, X.single_year)
_scalar("relax_query", "orders", "o_orderkey", S.RAW_QUERY, X.relax_query)
_scalar("url_domain", "pages", "page_id", "url", X.url_domain)
_scalar("canonical_domain", "pages", "page_id", "url", X.canonical_domain)
_scalar("next_page_url", "pages", "page_id", "url", X.next_page_url)
_scalar("compliance_gate", "pages", "page_id", "concat(CASE page_id % 6 WHEN 0 THEN 'https://www.linkedin.com/in/' WHEN 1 THEN 'ftp://a.b/' WHEN 2 THEN 'http://u:p@host.org/' WHEN 3 THEN 'https://host.org:0/' WHEN 4 THEN 'https://notlinkedin.com/' ELSE '' END, url)", web.compliance_reason)


@query
def norm_value(spark: SparkSession, sf: str) -> DataFrame:
    kind = F.expr("CASE p_partkey % 3 WHEN 0 THEN 'url' WHEN 1 THEN 'number' ELSE 'string' END")
    raw = F.expr("CASE p_partkey % 3 WHEN 0 THEN concat(' HTTPS://Host.org/', p_partkey, '//') WHEN 1 THEN concat(' about ', p_partkey, ',', 100 + p_size, '.5 ') ELSE concat(' ', p_type, '   ', p_brand) END")
    return S.table(spark, sf, "part").select(F.col("p_partkey").alias("id"), X.norm_value(raw, kind).alias("result"))


@query
def normalize_value(spark: SparkSession, sf: str) -> DataFrame:
    rows = S.table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.expr(S.RAW_DATE).alias("d"), F.expr(S.RAW_NUMBER).alias("n"))
    return rows.select("id", X.normalize_value(F.col("d"), F.lit("date"), F.lit(2025)).alias("as_date"), X.normalize_value(F.col("n"), F.lit("number")).alias("as_number"), X.normalize_value(F.col("n"), F.lit("string")).alias("as_string"))


@query
def same_domain(spark: SparkSession, sf: str) -> DataFrame:
    """Pages of a domain met by an equi-join on it: the pairs' count follows from the group's size."""
    rows = S.table(spark, sf, "pages").select("page_id", X.canonical_domain(F.col("url")).alias("domain"))
    return rows.where("domain IS NOT NULL").groupBy("domain").agg(F.count("*").alias("pages"), F.min("page_id").alias("first_page"), (F.count("*") * (F.count("*") - 1) / 2).cast("long").alias("pairs"))


@query
def chunk_documents(spark: SparkSession, sf: str) -> DataFrame:
    rows = S.table(spark, sf, "documents").select("doc_id", F.posexplode(X.chunks(F.col("text"))).alias("pos", "chunk"))
    return rows.select("doc_id", "pos", F.length("chunk").alias("chars"), F.md5("chunk").alias("chunk_md5"))


@query
def clean_html(spark: SparkSession, sf: str) -> DataFrame:
    return S.table(spark, sf, "pages").select("page_id", X.clean_html(F.col("html")).alias("clean")).select("page_id", "clean", X.needs_render(F.col("clean")).alias("needs_render"))


@query
def consecutive_dedupe(spark: SparkSession, sf: str) -> DataFrame:
    return S.table(spark, sf, "documents").select("doc_id", F.size(F.split("text", "\n")).alias("lines"), F.md5(F.array_join(X.dedupe_consecutive(F.split("text", "\n")), "\n")).alias("deduped_md5"))


@query
def page_cache(spark: SparkSession, sf: str) -> DataFrame:
    return S.table(spark, sf, "pages").select(F.sha2("url", 256).alias("key"), "url", F.length("html").alias("chars"))


@query
def public_ip(spark: SparkSession, sf: str) -> DataFrame:
    """Addresses of several classes made from user ids; classification needs Python's address library."""
    a = F.expr("CASE user_id % 6 WHEN 0 THEN concat('10.0.0.', user_id % 250) WHEN 1 THEN concat('8.8.4.', user_id % 250) WHEN 2 THEN '::ffff:8.8.8.8' WHEN 3 THEN '2002:808:808::1' WHEN 4 THEN '2606:4700::1111' ELSE '169.254.169.254' END")
    return S.table(spark, sf, "events").select("user_id").distinct().select("user_id", a.alias("address")).withColumn("public", web.public_address("address"))


@query
def robots_gate(spark: SparkSession, sf: str) -> DataFrame:
    """Pages that their site's robots file allows; a file for each domain, joined by it."""
    pages = S.table(spark, sf, "pages").select("page_id", "url", X.canonical_domain(F.col("url")).alias("domain"))
    rules = pages.groupBy("domain").agg(F.count("*").alias("n")).select("domain", F.when(F.col("n") % 2 == 0, "User-agent: *\nDisallow: /p").otherwise("").alias("body"), F.when(F.col("n") % 3 == 0, 404).otherwise(200).alias("status"))
    return pages.join(rules, "domain").select("page_id", web.robots_allow("body", "status", "url", F.lit("tablewright")).alias("allowed"))


@query
def next_link(spark: SparkSession, sf: str) -> DataFrame:
    return S.table(spark, sf, "pages").select("page_id", X.next_link(F.col("html"), F.col("url")).alias("next_url"))


@query
def decode_bytes(spark: SparkSession, sf: str) -> DataFrame:
    rows = S.table(spark, sf, "documents").select("doc_id", F.encode("text", "UTF-8").alias("raw"))
    return rows.select("doc_id", F.md5(web.decode_bytes("raw", F.lit(None).cast("string"))).alias("decoded_md5"))


@query
def content_type_filter(spark: SparkSession, sf: str) -> DataFrame:
    kind = F.expr("CASE page_id % 4 WHEN 0 THEN 'text/html; charset=utf-8' WHEN 1 THEN 'application/pdf' WHEN 2 THEN 'text/plain' ELSE 'image/png' END")
    return S.table(spark, sf, "pages").select("page_id", kind.alias("content_type")).where(F.col("content_type").contains("html") | F.col("content_type").contains("text"))


#: Words of a passage on which it meets pages.
WINDOW = 5


@query
def quote_on_page(spark: SparkSession, sf: str) -> DataFrame:
    """Each document with the benchmark passages it holds, one row for each, or a null ``item_id``.

    A page that holds a passage has all its inner words as whole words, so both meet on a window of these and the predicate decides.
    Passages too short for a window are looked for on every page.
    """
    docs = S.table(spark, sf, "documents").select("doc_id", "text", F.lower(F.regexp_replace(F.coalesce("text", F.lit("")), r"(?U)\s+", " ")).alias("page")).withColumn("h", F.xxhash64("page"))
    items = S.table(spark, sf, "benchmark").select("item_id", F.col("text").alias("quote")).withColumn("words", F.split(X.norm_text(F.col("quote")), " "))
    enough = F.size("words") >= WINDOW + 2
    window = lambda words, at: F.xxhash64(F.array_join(F.slice(words, at, WINDOW), " "))
    keyed = items.where(enough).select("item_id", "quote", window(F.col("words"), F.lit(2)).alias("w"))
    spots = docs.select("h", truth._once(F.split("page", " ")).alias("words"))
    spots = spots.select("h", F.explode(F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("words") - WINDOW + 1)), lambda i: window(F.col("words"), i)))).alias("w"))
    found = docs.select("h", "text").join(spots.join(keyed, "w").select("h", "item_id", "quote").distinct(), "h")
    short = docs.select("h", "text").crossJoin(items.where(~enough).select("item_id", "quote"))
    hits = found.unionByName(short).where(X.quote_on_page(F.col("quote"), F.col("text"))).select("h", "item_id").distinct()
    own = X.quote_on_page(F.concat(F.lit("  "), F.substring("text", 11, 60)), F.col("text"))
    return docs.select("doc_id", "h", own.alias("own_on_page")).join(hits, "h", "left").select("doc_id", "item_id", "own_on_page")


@query
def value_in_quote(spark: SparkSession, sf: str) -> DataFrame:
    rows = S.table(spark, sf, "lineitem").select(F.expr(S.QUOTED_VALUE).alias("value"), F.expr(S.QUOTE).alias("quote"))
    return rows.withColumn("backed", X.value_in_quote(F.col("value"), F.col("quote"))).groupBy("value", "backed").agg(F.count("*").alias("n"))


@query
def fields_sourced(spark: SparkSession, sf: str) -> DataFrame:
    rows = S.table(spark, sf, "lineitem").select(F.col("l_partkey").alias("entity"), (F.col("l_quantity") > 20).alias("verified"))
    return merge.fields_sourced(rows)


@query
def page_gate(spark: SparkSession, sf: str) -> DataFrame:
    rows = S.table(spark, sf, "documents").select("doc_id", F.expr("CASE WHEN doc_id % 13 = 0 THEN NULL ELSE (doc_id % 100) / 100D END").alias("p"))
    return gates.page_gate(rows)


@query
def filter_gate(spark: SparkSession, sf: str) -> DataFrame:
    rows = S.table(spark, sf, "documents").select("doc_id", F.expr("CASE WHEN doc_id % 10 = 0 THEN array() ELSE array((doc_id % 7) / 7D, CASE WHEN doc_id % 5 = 0 THEN NULL ELSE (doc_id % 11) / 11D END) END").cast("array<double>").alias("p"))
    return gates.filter_gate(rows).select("doc_id", "filter_uncertain")


@query
def claim_plan(spark: SparkSession, sf: str) -> DataFrame:
    """Fields of a record as rows, those without value and evidence left out, with their support."""
    rows = S.table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.explode(F.array(
        F.struct(F.lit("discount").alias("field"), F.when(F.col("l_discount") > 0, F.col("l_discount")).alias("value"), F.when(F.col("l_tax") > 0, F.lit("quote")).alias("evidence")),
        F.struct(F.lit("tax").alias("field"), F.when(F.col("l_tax") > 0.02, F.col("l_tax")).alias("value"), F.when(F.col("l_discount") > 0.03, F.lit("quote")).alias("evidence")))).alias("c")).select("l_partkey", "c.*")
    planned = gates.claim_plan(rows).withColumn("support", gates.support(F.when(F.col("l_partkey") % 2 == 0, F.lit(0.9))))
    return planned.groupBy("field", "support").agg(F.count("*").alias("n"), F.count("value").alias("with_value"), F.count("evidence").alias("with_evidence"))


@query
def has_primary(spark: SparkSession, sf: str) -> DataFrame:
    rows = S.table(spark, sf, "lineitem").select(F.expr("CASE WHEN l_linenumber = 1 THEN NULL WHEN l_linenumber = 2 THEN '' ELSE cast(l_linenumber - 3 AS string) END").alias("pk"), "l_quantity")
    return gates.has_primary(rows, "pk").groupBy("pk").agg(F.count("*").alias("n"))


@query
def public_metadata(spark: SparkSession, sf: str) -> DataFrame:
    m = F.create_map(F.lit("type"), F.col("event_type"), F.concat(F.lit("_user"), (F.col("user_id") % 3).cast("string")), F.lit("x"))
    return S.table(spark, sf, "events").select("event_id", F.map_keys(gates.public_metadata(m))[0].alias("key"), F.size(gates.public_metadata(m)).alias("n"))


@query
def premise_hypothesis(spark: SparkSession, sf: str) -> DataFrame:
    rows = S.table(spark, sf, "documents").select("doc_id", F.col("text").alias("quote"), F.when(F.col("doc_id") % 2 == 0, F.expr("substring(text, 101)")).alias("context"), "lang")
    return rows.select("doc_id", F.md5(X.build_premise(F.col("quote"), F.col("context"))).alias("premise_md5"), X.build_hypothesis(F.col("lang"), F.lit("language"), F.col("doc_id").cast("string")).alias("hypothesis"))


def _answers(spark: SparkSession, sf: str) -> DataFrame:
    raw = F.expr("""CASE event_id % 4 WHEN 0 THEN concat('{"type": "noul", "noul": 0.', event_id % 100, '}') WHEN 1 THEN '{"type": "choice", "choice": "b"}' WHEN 2 THEN '{"type": "noul", "noul": "x"}' ELSE 'broken' END""")
    return S.table(spark, sf, "events").select("event_id", raw.alias("answer"))


@query
def judge_answers(spark: SparkSession, sf: str) -> DataFrame:
    return _answers(spark, sf).select("event_id", X.probability_answer(F.col("answer")).alias("p"), X.choice_answer(F.col("answer")).alias("choice"))


@query
def format_error(spark: SparkSession, sf: str) -> DataFrame:
    raw = F.expr("""CASE event_id % 6 WHEN 0 THEN concat('Error 400: {"error": {"message": "bad request ', event_id, ' "}}') WHEN 1 THEN '{"message": " too slow "}' WHEN 2 THEN '{"error": {"message": "no. See ''failed_generation'' for more details.", "failed_generation": " x "}}' WHEN 3 THEN '' WHEN 4 THEN concat('Error: {''error'': {''message'': "it''s ', event_id, '", ''code'': None, ''retry'': True}}') ELSE concat(' plain ', event_type) END""")
    return S.table(spark, sf, "events").select("event_id", X.error_message(web.literal_as_json(raw)).alias("message"))


@query
def trust_scores(spark: SparkSession, sf: str) -> DataFrame:
    """Logit, sigmoid and softmax over three scores of a row."""
    p = F.col("l_discount") * 10
    soft = X.softmax(F.array("l_discount", "l_tax", F.lit(0.05)))
    return S.table(spark, sf, "lineitem").select("l_discount", "l_tax", F.round(X.logit(p), 9).alias("logit"), F.round(X.sigmoid(X.logit(p)), 9).alias("back"), F.round(F.get(soft, F.lit(0)), 9).alias("soft_first")).distinct()


# Entities


@query
def entity_keys(spark: SparkSession, sf: str) -> DataFrame:
    return entity.entity_keys(S.table(spark, sf, "part").select("p_partkey", F.expr(S.RAW_NAME).alias("raw")), "raw").select("p_partkey", "entity_key")


@query
def match_existing_key(spark: SparkSession, sf: str) -> DataFrame:
    rows = S.table(spark, sf, "part").select(F.col("p_partkey").alias("seq"), X.normalize_name(F.expr("CASE WHEN p_partkey % 2 = 0 THEN replace(" + S.RAW_NAME + ", ' ', '') ELSE " + S.RAW_NAME + " END")).alias("key"))
    return entity.match_existing_key(rows)


@query
def group_by_entity(spark: SparkSession, sf: str) -> DataFrame:
    return entity.group_by_entity(S.table(spark, sf, "part").select("p_partkey", F.expr(S.RAW_NAME).alias("raw")), "raw", "p_partkey")


@query
def entity_components(spark: SparkSession, sf: str) -> DataFrame:
    """Suppliers joined by the parts they deliver, as a union of sets: each is linked to the smallest supplier of its part."""
    from ..storage import checkpointed

    checkpointed(spark)
    rows = S.table(spark, sf, "lineitem").select("l_partkey", F.col("l_suppkey").alias("b")).distinct()
    rows = rows.join(rows.groupBy("l_partkey").agg(F.min("b").alias("a")), "l_partkey")
    return entity.components(rows.select("a", "b")).select(F.col("node").alias("supplier"), "root")


@query
def dedupe_urls(spark: SparkSession, sf: str) -> DataFrame:
    rows = S.table(spark, sf, "pages").select(X.url_domain(F.col("url")).alias("url"), F.md5("html").alias("title"), F.col("page_id").alias("rank"))
    return entity.earliest_per_key(rows, "url", "rank")


# Relational reads and keyed writes


@query
def runs_with_counts(spark: SparkSession, sf: str) -> DataFrame:
    """Runs with the number of their records, newest first: the correlated count as a join on a grouped count."""
    runs = S.table(spark, sf, "customer").select(F.col("c_custkey").alias("run"), "c_mktsegment")
    counts = S.table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("run")).agg(F.count("*").alias("n"))
    return runs.join(counts, "run", "left").select("run", "c_mktsegment", F.coalesce("n", F.lit(0)).alias("records")).orderBy(F.col("run").desc())


@query
def claims_filtered(spark: SparkSession, sf: str) -> DataFrame:
    """Claims with optional predicates on entity and field, in order."""
    wanted: dict[str, object] = {"field": "discount", "domain": "7"}
    rows = S.claims(spark, sf)
    for column, value in wanted.items():
        rows = rows.where(F.col(column) == value)
    return rows.select("run", "entity", "seq", "value", "url").orderBy("seq")


@query
def captures_of_run(spark: SparkSession, sf: str) -> DataFrame:
    """The captures of a run in order, with their visits."""
    rows = S.visits(spark, sf).where("run = '2024-01-03'")
    return rows.groupBy("run", "capture").agg(F.min("seq").alias("first_seq"), F.count("*").alias("visits")).orderBy("first_seq")


@query
def records_of_run(spark: SparkSession, sf: str) -> DataFrame:
    """Records of every run with their fields as a map, numbered in the order in which they were found."""
    rows = merge.records(merge.upsert_records(S.claims(spark, sf), found=True)).where("run IS NOT NULL AND entity IS NOT NULL")
    return rows.select("run", "entity", "id", F.col("fields")["discount"].alias("discount"), "found")


@query
def typed_events(spark: SparkSession, sf: str) -> DataFrame:
    """Progress events with the typed payload of their kind; what is no such payload is null."""
    payload = F.concat(F.lit('{"type": "'), F.col("event_type"), F.lit('", "data": '), F.col("props"), F.lit("}"))
    rows = S.table(spark, sf, "events").select("event_id", F.from_json(payload, "type string, data struct<k: int>").alias("e"))
    return rows.select("event_id", "e.type", F.col("e.data.k").alias("k"))


@query
def fetch_schedule(spark: SparkSession, sf: str) -> DataFrame:
    """When each page may be asked for, a domain's pages one after another."""
    rows = S.table(spark, sf, "pages").select("url", "page_id", F.col("page_id").alias("rank"), X.canonical_domain(F.col("url")).alias("domain"))
    rows = rows.withColumn("crawl_delay", F.when(F.length("domain") % 2 == 0, F.lit(2.5)))
    return planner.fetch_schedule(rows).select("page_id", "domain", "start_s")


@query
def labels_of_claims(spark: SparkSession, sf: str) -> DataFrame:
    return S.human_labels(spark, sf).join(S.scores(spark, sf), "id").select("id", "correct", "score")


@query
def record_lookup(spark: SparkSession, sf: str) -> DataFrame:
    return S.table(spark, sf, "orders").where("o_custkey = 7").select("o_orderkey", "o_orderstatus").orderBy("o_orderkey")


@query
def source_ledger(spark: SparkSession, sf: str) -> DataFrame:
    return merge.source_ledger(S.visits(spark, sf)).select("id", "status", "status_final", "records_found")


@query
def run_stats(spark: SparkSession, sf: str) -> DataFrame:
    return planner.run_stats(merge.source_ledger(S.visits(spark, sf)))


@query
def label_upsert(spark: SparkSession, sf: str) -> DataFrame:
    rows = S.table(spark, sf, "events").select((F.col("event_id") % 500).alias("claim_id"), (F.col("value") > 50).cast("int").alias("correct"), F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("labeler"), F.col("event_id").alias("seq"), F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("created_at"))
    return merge.label_upsert(rows)


@query
def upsert_records(spark: SparkSession, sf: str) -> DataFrame:
    c = merge.upsert_records(S.claims(spark, sf))
    return c.select("run", "entity", "value", "url", "corroborated_by", F.size("conflicts").alias("n_conflicts"), F.array_join(F.transform("conflicts", lambda x: F.concat(x["url"], F.lit("="), x["value"])), ";").alias("conflicts"))


@query
def export_rows(spark: SparkSession, sf: str) -> DataFrame:
    cells = merge.upsert_records(S.claims(spark, sf))
    first = F.struct("field", "value", (F.col("value") == "0.05").alias("verified"))
    second = F.struct(F.lit("supplier").alias("field"), F.col("url").alias("value"), F.lit(True).alias("verified"))
    return merge.export_rows(cells.select("run", "entity", "url", "conflicts", F.inline(F.array(first, second))), ["discount", "supplier"])


@query
def has_conflict(spark: SparkSession, sf: str) -> DataFrame:
    return merge.upsert_records(S.claims(spark, sf)).groupBy((F.size("conflicts") > 0).alias("has_conflict")).agg(F.count("*").alias("cells"))


# Coverage


@query
def chao2_estimate(spark: SparkSession, sf: str) -> DataFrame:
    return coverage.estimate(S.incidence_orders(spark, sf))


@query
def chao2_events(spark: SparkSession, sf: str) -> DataFrame:
    return coverage.estimate(S.incidence_events(spark, sf))


@query
def bootstrap_ci(spark: SparkSession, sf: str) -> DataFrame:
    return coverage.bootstrap_interval(S.incidence_orders(spark, sf))


@query
def coverage_summary(spark: SparkSession, sf: str) -> DataFrame:
    return coverage.summary(S.incidence_orders(spark, sf))


@query
def coverage_trajectory(spark: SparkSession, sf: str) -> DataFrame:
    return coverage.trajectory(S.incidence_orders(spark, sf))


@query
def marginal_yield(spark: SparkSession, sf: str) -> DataFrame:
    return coverage.marginal_yield(coverage.trajectory(S.incidence_events(spark, sf))).select("t", "new_entities", "marginal_yield")


@query
def stop_capture(spark: SparkSession, sf: str) -> DataFrame:
    return coverage.stop_capture(coverage.trajectory_bounds(S.incidence_orders(spark, sf))).select("t", "coverage_lo", "marginal_yield", "stop")


# Truth


@query
def kbt_voters(spark: SparkSession, sf: str) -> DataFrame:
    return truth.voters(S.claims(spark, sf)).select("run", "entity", "url", "seq", "value", "support")


@query
def kbt_probs(spark: SparkSession, sf: str) -> DataFrame:
    return truth.value_probabilities(truth.voters(merge.by_cell(S.claims(spark, sf)))).select("run", "entity", "v", F.round("prob", 6).alias("prob"))


@query
def kbt_winner(spark: SparkSession, sf: str) -> DataFrame:
    return truth.winners(S.claims(spark, sf)).select("run", "entity", "value", "url", "prob")


@query
def conflicts_resolved(spark: SparkSession, sf: str) -> DataFrame:
    return truth.resolved_records(S.claims(spark, sf), numeric=["discount"]).select("run", "entity", "value", "url", "kbt_prob", "conflict_note", "resolved")


# Audit


@query
def ppi_accuracy(spark: SparkSession, sf: str) -> DataFrame:
    return audit.ppi_accuracy(S.scores(spark, sf), S.human_labels(spark, sf)).select(*(F.round(c, 9).alias(c) for c in ("theta_hat", "ci_low", "ci_high", "se")), "n_cells", "n_labeled")


@query
def ppi_unlabeled(spark: SparkSession, sf: str) -> DataFrame:
    return audit.ppi_accuracy(S.scores(spark, sf)).select(*(F.round(c, 9).alias(c) for c in ("theta_hat", "ci_low", "ci_high", "se")), "n_cells", "n_labeled")


@query
def audit_sample(spark: SparkSession, sf: str) -> DataFrame:
    return audit.audit_sample(S.scores(spark, sf)).select("id", "score", "uncertain")


@query
def conformal_threshold(spark: SparkSession, sf: str) -> DataFrame:
    rows = S.table(spark, sf, "lineitem").select(F.round(F.col("l_quantity") / 50, 2).alias("score"), F.when((F.col("l_orderkey") * 7 + F.col("l_partkey")) % 1000 < F.greatest(F.lit(0), 300 - 6 * F.col("l_quantity")), 0).otherwise(1).alias("correct"))
    return audit.conformal_threshold(rows)


# Planning and evaluation


def _queries(spark: SparkSession, sf: str) -> DataFrame:
    return S.table(spark, sf, "nation").select(F.col("n_nationkey").alias("seq"), F.col("n_name").alias("query"))


@query
def capture_combos(spark: SparkSession, sf: str) -> DataFrame:
    return planner.capture_combos(_queries(spark, sf), ENGINES)


@query
def untried_combos(spark: SparkSession, sf: str) -> DataFrame:
    combos = planner.capture_combos(_queries(spark, sf), ENGINES)
    return planner.untried(combos, combos.where("n % 3 = 1").drop("n"))


@query
def replan_filter(spark: SparkSession, sf: str) -> DataFrame:
    return planner.replan_filter(_queries(spark, sf), _queries(spark, sf).where("seq % 2 = 0").select(F.lower("query").alias("query")))


@query
def replan_trigger(spark: SparkSession, sf: str) -> DataFrame:
    rows = S.visits(spark, sf).groupBy("run", "capture").agg(F.count("*").alias("chunks"), F.count_if(F.col("status") == "skipped").alias("gated"), F.sum("records_found").alias("new_entities"))
    return planner.replan_trigger(rows)


@query
def top_urls(spark: SparkSession, sf: str) -> DataFrame:
    return planner.top_urls(S.visits(spark, sf).select("capture", "url", F.col("seq").alias("rank")))


@query
def relaxed_results(spark: SparkSession, sf: str) -> DataFrame:
    rows = S.table(spark, sf, "events").select((F.col("user_id") % 60).cast("string").alias("query"), F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("url"), F.col("event_id").alias("rank"))
    strict = rows.where("rank % 97 < 2")
    return planner.relaxed(strict, rows)


def _pred_gold(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    rows = S.table(spark, sf, "customer").select(X.normalize_name(F.col("c_name")).alias("entity_key"), "c_mktsegment", F.col("c_nationkey").cast("string").alias("nation"), "c_custkey")
    pred = rows.where("c_custkey % 3 <> 0").withColumn("c_mktsegment", F.when(F.col("c_custkey") % 7 == 0, "other").otherwise(F.col("c_mktsegment")))
    return pred, rows.where("c_custkey % 4 <> 0").withColumn("nation", F.when(F.col("c_custkey") % 5 != 0, F.col("nation")))


@query
def item_f1(spark: SparkSession, sf: str) -> DataFrame:
    return evaluation.item_scores(*_pred_gold(spark, sf))


@query
def row_f1(spark: SparkSession, sf: str) -> DataFrame:
    return evaluation.row_scores(*_pred_gold(spark, sf), ["c_mktsegment", "nation"])


def _results(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("n_nationkey")
    return S.table(spark, sf, "nation").select(F.col("n_name").alias("task_id"), F.concat(F.lit("v"), (k % 3).cast("string")).alias("version"), (k / 30).alias("item_f1"), (k / 60).alias("row_f1"), (k / 25).alias("coverage_est"), ((k % 9) / 9).alias("item_recall"), (k % 6 * 10).alias("n_gold"))


@query
def cce(spark: SparkSession, sf: str) -> DataFrame:
    return evaluation.aggregate_metrics(_results(spark, sf)).select("n_tasks", *(F.round(c, 9).alias(c) for c in ("mean_item_f1", "mean_row_f1", "cce")), "n_cce_tasks")


@query
def calibration_points(spark: SparkSession, sf: str) -> DataFrame:
    return evaluation.calibration_points(_results(spark, sf))


@query
def ablation_pivot(spark: SparkSession, sf: str) -> DataFrame:
    return evaluation.ablation(_results(spark, sf), ["v0", "v1", "v2"]).select("metric", *(F.round(c, 9).alias(c) for c in ("v0", "v1", "v2")))


# Streaming and the whole engine


@query
def stream_windows(spark: SparkSession, sf: str) -> DataFrame:
    """The batch form of the windowed stream: counts and sums by hour and type."""
    rows = S.table(spark, sf, "events")
    return rows.groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total")).select(F.date_format("w.start", "yyyy-MM-dd HH:mm:ss").alias("start"), "event_type", "n", "total")


@query
def stream_coverage(spark: SparkSession, sf: str) -> DataFrame:
    """The estimate of a stream of detections whose batches have all arrived."""
    import uuid

    from ..storage import checkpointed
    from ..streaming.coverage import DELTAS, running_estimate, watch_coverage

    base = f"{checkpointed(spark).rstrip('/')}/tablewright/stream-{uuid.uuid4().hex}"
    S.incidence_orders(spark, sf).repartition(4).write.parquet(f"{base}/in")
    schema = spark.read.parquet(f"{base}/in").schema
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 2).parquet(f"{base}/in")
    watch_coverage(source, f"{base}/seen", lambda number, estimate: False, f"{base}/checkpoint").awaitTermination()
    return running_estimate(spark.read.schema(DELTAS).parquet(f"{base}/seen"))


@query
def pipeline_records(spark: SparkSession, sf: str) -> DataFrame:
    """A whole request over the pages with offline providers."""
    from ..sources.providers import PatternExtract, StaticFetch, StaticSearch
    from .engine import DataSpec, FieldSpec, run

    pages = S.table(spark, sf, "pages")
    index = pages.select("url", F.regexp_extract("html", r"(?is)<title[^>]*>(.*?)</title>", 1).alias("html_title"), F.translate("url", "/:.-?=&", "       ").alias("title"))
    spec = DataSpec("the of and", [FieldSpec("name"), FieldSpec("number", "number")], ["https com page", "example org", "www net"])
    extract = PatternExtract({"name": r"(?m)^([A-Z][a-z]{3,})\b", "number": r"\b(\d{2,})\b"})
    result = run(spark, spec, StaticSearch(index.select("url", "title")), StaticFetch(pages.select("url", "html")), extract, max_captures=3)
    return result.records.select("entity", "field", "value", "url", F.size("conflicts").alias("n_conflicts"), "resolved")
