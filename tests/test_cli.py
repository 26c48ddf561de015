"""The command line and the functions under their SQL names."""

import csv
import glob
import json

from pyspark.sql import functions as F

from tablewright import __main__ as cli
from tablewright.functions.sql import SQL_FUNCTIONS, register


def test_demo_and_score(spark, tmp_path, capsys):
    pages = [("https://a.org/1", "open data", "<p>Prize: Open Award. Amount: 5</p>"), ("https://b.org/2", "open data", "<p>Prize: Other Award. Amount: 6</p>")]
    spark.createDataFrame(pages, "url string, title string, html string").write.parquet(f"{tmp_path}/pages")
    cli.main(["demo", f"{tmp_path}/pages", "--entity", "prize", "--query", "open data", "--field", r"name=Prize: ([A-Z][A-Za-z ]+)", "--field", "amount=Amount: ([0-9]+)", "--csv", f"{tmp_path}/out"])
    rows = [r for f in glob.glob(f"{tmp_path}/out/*.csv") for r in csv.DictReader(open(f))]
    assert sorted((r["name"], r["amount"], r["fields_sourced"]) for r in rows) == [("Open Award", "5", "1.0"), ("Other Award", "6", "1.0")]
    assert "done" in capsys.readouterr().out
    (tmp_path / "r.json").write_text(json.dumps([{"task_id": "t1", "version": "v", "item_f1": 0.5, "row_f1": 0.25, "coverage_est": 1.0, "item_recall": 0.5, "n_gold": 4}, {"task_id": "t2", "version": "v", "item_f1": 1.0, "row_f1": 0.75, "coverage_est": 0.5, "item_recall": None, "n_gold": 0}]))
    cli.main(["score", str(tmp_path / "r.json")])
    shown = capsys.readouterr().out
    assert "|mean   |0.75   |0.5   |0.75        |0.5          |" in shown and "|t2     |1.0" in shown


def test_functions_in_sql(spark):
    assert register(spark) == sorted(SQL_FUNCTIONS)
    texts = ["  Acme's  (x) Pvt. Ltd. - best 2024", "https://www.Host.org:80/a?page=3&q=1#f", 'site:x.org "a" AND b -c', '{"type": "noul", "noul": 0.25}', '{"error": {"message": "it\'s \\\\ bad"}}', "", None]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, x string")
    rows.createOrReplaceTempView("sql_texts")
    names = sorted(SQL_FUNCTIONS)
    by_sql = spark.sql(f"SELECT i, {', '.join(f'{n}(x) AS {n}' for n in names)} FROM sql_texts ORDER BY i").collect()
    assert by_sql == rows.select("i", *(SQL_FUNCTIONS[n](F.col("x")).alias(n) for n in names)).orderBy("i").collect()
