"""Command line: ``query`` shows a registered query, ``demo`` runs an offline request over a table of pages, ``score`` prints scores of result files by task."""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import evaluation
from .plans.engine import DataSpec, FieldSpec, run
from .plans.queries import QUERIES
from .sources.providers import PatternExtract, StaticFetch, StaticSearch
from .sources.sinks import read_json, write_csv

RESULT = "task_id string, version string, item_f1 double, row_f1 double, coverage_est double, item_recall double, n_gold int"


def per_task(results: DataFrame) -> DataFrame:
    """What the console shows of each task, and a last row of means."""
    shown = ("item_f1", "row_f1", "coverage_est")
    rows = results.select("task_id", *shown, evaluation.true_coverage(F.col("item_recall"), F.col("n_gold")).alias("coverage_true"))
    means = rows.agg(*(F.avg(c).alias(c) for c in (*shown, "coverage_true"))).select(F.lit("mean").alias("task_id"), "*")
    return rows.orderBy("task_id").unionByName(means)


def demo(spark: SparkSession, pages: str, entity: str, queries: list[str], patterns: dict[str, str], out: str | None, captures: int) -> DataFrame:
    """Records of an offline request over a Parquet table ``url, title, html``, as rows of the export."""
    rows = spark.read.parquet(pages)
    title = F.col("title") if "title" in rows.columns else F.translate("url", "/:.-?=&", "       ")
    spec = DataSpec(entity, [FieldSpec(n) for n in patterns], queries)
    result = run(spark, spec, StaticSearch(rows.select("url", title.alias("title"))), StaticFetch(rows.select("url", "html")), PatternExtract(patterns), max_captures=captures)
    print(f"{result.status}{': ' + result.error if result.error else ''}; {result.stats}")
    if out:
        write_csv(result.export_rows(), out)
    return result.export_rows()


def main(argv: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="tablewright", description=__doc__)
    commands = parser.add_subparsers(dest="command", required=True)
    one = commands.add_parser("query", help="show a registered query")
    one.add_argument("name", choices=sorted(QUERIES))
    one.add_argument("sf_dir")
    two = commands.add_parser("demo", help="run an offline request")
    two.add_argument("pages")
    two.add_argument("--entity", required=True)
    two.add_argument("--query", action="append", required=True)
    two.add_argument("--field", action="append", required=True, metavar="NAME=PATTERN", help="the first is the primary field; group 1 is the value")
    two.add_argument("--captures", type=int, default=3)
    two.add_argument("--csv")
    three = commands.add_parser("score", help="print scores by task")
    three.add_argument("results")
    asked = parser.parse_args(argv)
    spark = SparkSession.builder.getOrCreate()
    if asked.command == "query":
        QUERIES[asked.name](spark, asked.sf_dir).show(50, False)
    elif asked.command == "demo":
        demo(spark, asked.pages, asked.entity, asked.query, dict(f.split("=", 1) for f in asked.field), asked.csv, asked.captures).show(50, False)
    else:
        results = read_json(spark, asked.results, RESULT)
        per_task(results).show(200, False)
        evaluation.aggregate_metrics(results).show()


if __name__ == "__main__":
    main()
