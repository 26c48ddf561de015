"""The corpus pipeline, stage by stage, against each stage's own brute force."""

import pytest

pipeline = pytest.importorskip("corpus_pipeline")
SF = "/root/testdata/sf0.001"


def test_stages(spark):
    from test_near_dup import slow_kept

    from tablewright.llm import quality_rules

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    seen = {}
    for name, stage in pipeline.STAGES:
        seen[name] = docs
        docs = stage(spark, docs, SF).cache()
        if name != pipeline.STAGES[-1][0]:
            assert docs.columns == seen["quality_rules"].columns
        seen[f"{name} out"] = docs
    ids = lambda n: sorted(r["doc_id"] for r in seen[n].select("doc_id").collect())
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    assert ids("quality_rules out") == sorted(r["doc_id"] for r in quality_rules.quality_report(seen["quality_rules"], labels).where("kept").collect())
    assert ids("line_dedup out") == ids("line_dedup")
    rows = sorted((r["doc_id"], r["text"]) for r in seen["simhash_near_dedup"].collect())
    assert ids("simhash_near_dedup out") == slow_kept(rows)
    assert set(ids("mixing out")) == set(ids("mixing"))
    starts = sorted(r["doc_id"] for r in docs.where("start = 0").collect())
    assert starts == ids("mixing out")


def test_run_is_the_stages(spark):
    assert pipeline.run(spark, SF).selectExpr("sum(length)").first()[0] > 0


def test_edges(spark, edge, empty, marks, tmp_path):
    """Nulls, empty and long texts, ties, repeated rows, clashing columns and an empty table pass through all stages."""
    marks.write.parquet(f"{tmp_path}/labels.parquet")
    for rows, some in ((edge, True), (empty, False)):
        docs = rows
        for name, stage in pipeline.STAGES:
            before, docs = docs, stage(spark, docs, str(tmp_path)).cache()
            assert name == "packing" or docs.columns == rows.columns
        assert (docs.count() > 0) == some
