"""The scalar functions under their names in SQL, as temporary functions whose bodies are built-in expressions, so plans stay the same as from Python."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from . import text as X
from . import web

#: Name -> function of one text. Those with lambdas in their body cannot be written as SQL text and are left to Python.
SQL_FUNCTIONS: dict[str, Callable[[Column], Column]] = {
    "norm_text": X.norm_text,
    "normalize_name": X.normalize_name,
    "compact_key": X.compact_key,
    "relax_query": X.relax_query,
    "url_domain": X.url_domain,
    "canonical_domain": X.canonical_domain,
    "next_page_url": X.next_page_url,
    "needs_render": X.needs_render,
    "url_fault": web.url_fault,
    "probability_answer": X.probability_answer,
    "choice_answer": X.choice_answer,
    "error_message": X.error_message,
}


def register(spark: SparkSession) -> list[str]:
    """Makes the functions known to the session's SQL; gives their names."""
    for name, f in SQL_FUNCTIONS.items():
        rows = spark.createDataFrame([], "x string").select(f(F.col("x")).alias("r"))
        body = rows._jdf.queryExecution().analyzed().expressions().head().child().sql()
        kind = rows.schema["r"].dataType.simpleString()
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}(x STRING) RETURNS {kind} RETURN {body}")
    return sorted(SQL_FUNCTIONS)
