"""Pluggable providers with offline, deterministic stand-ins. A stand-in's scores are word overlaps, not model quality."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce
from typing import Protocol

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import clean_html, next_link, tokens
from ..operators.gates import FILTER_CHARS, GATE_CHARS

#: Characters of a quote that a judge sees.
SUPPORT_CHARS = 600


class Search(Protocol):
    def results(self, queries: DataFrame) -> DataFrame:
        """``query, rank, url, title`` for rows of ``query``."""


class Fetch(Protocol):
    def pages(self, urls: DataFrame) -> DataFrame:
        """``url, page_no, text`` for rows of ``url``: a page and the ones that follow it."""


class Extract(Protocol):
    def cells(self, chunks: DataFrame) -> DataFrame:
        """``url, entity, field, value, evidence`` for rows of ``url, text``."""


class Judge(Protocol):
    """Scores of chunks, records and claims; null where the provider gives none."""

    def page(self, spec, text: Column) -> Column: ...

    def filters(self, spec, text: Column) -> Column: ...

    def support(self, value: Column, evidence: Column) -> Column: ...


@dataclass
class StaticSearch:
    """Ranks a table of pages ``url, title`` by the query's words in the title."""

    index: DataFrame

    def results(self, queries: DataFrame) -> DataFrame:
        words = self.index.select("url", "title", F.explode(F.array_distinct(tokens(F.lower("title")))).alias("w"))
        asked = queries.select("query", F.explode(F.array_distinct(tokens(F.lower("query")))).alias("w"))
        hits = asked.join(words, "w").groupBy("query", "url", "title").agg(F.count("*").alias("n"))
        return hits.select("query", F.rank().over(Window.partitionBy("query").orderBy(F.col("n").desc(), "url")).alias("rank"), "url", "title")


#: Pages that are followed from one URL, itself included.
MAX_PAGES = 3


@dataclass
class StaticFetch:
    """Pages from a table ``url, html``: the cached text is a table keyed by the URL's hash. Next links are followed ``depth`` pages far."""

    store: DataFrame
    depth: int = MAX_PAGES

    def pages(self, urls: DataFrame) -> DataFrame:
        held = self.store.select(F.col("url").alias("at"), "html")
        here, found = urls.select("url", F.col("url").alias("at")).distinct(), []
        for n in range(self.depth):
            got = here.join(held, "at")
            found.append(got.select("url", F.lit(n).alias("page_no"), F.sha2("at", 256).alias("key"), "at", clean_html(F.col("html")).alias("text")))
            onward = got.select("url", next_link(F.col("html"), F.col("at")).alias("next"), F.col("at").alias("was"))
            here = onward.where("next IS NOT NULL AND next <> was AND next <> url").select("url", F.col("next").alias("at"))
        rows = reduce(DataFrame.unionByName, found)
        # A page that comes up again ends nothing and is read once.
        first = rows.groupBy("url", "at").agg(F.min_by(F.struct("page_no", "key", "text"), "page_no").alias("r")).select("url", "r.*")
        return first.where("text <> ''")


@dataclass
class PatternExtract:
    """Cells by a regular expression for each field; group 1 is the value, the whole match the evidence. The first field is primary."""

    patterns: dict[str, str] = field(default_factory=dict)

    def cells(self, chunks: DataFrame) -> DataFrame:
        primary = next(iter(self.patterns.values()))
        rows = chunks.withColumn("entity", F.regexp_extract("text", primary, 1)).where("entity <> ''")
        each = [F.struct(F.lit(n).alias("field"), F.nullif(F.regexp_extract("text", p, 1), F.lit("")).alias("value"), F.nullif(F.regexp_extract("text", p, 0), F.lit("")).alias("evidence")) for n, p in self.patterns.items()]
        return rows.select(*chunks.columns, "entity", F.explode(F.array(*each)).alias("c")).select(*chunks.columns, "entity", "c.*").where("value IS NOT NULL OR evidence IS NOT NULL")


def lexical_score(wanted: Column, text: Column, chars: int) -> Column:
    """Share of the wanted words that the first ``chars`` characters hold."""
    asked = F.array_distinct(tokens(F.lower(wanted)))
    held = F.array_intersect(asked, tokens(F.lower(F.substring(text, 1, chars))))
    return F.when(F.size(asked) > 0, F.size(held) / F.size(asked)).otherwise(1.0)


class LexicalJudge:
    """A stand-in for a hosted judge: shares of the wanted words. Claims no model quality."""

    def page(self, spec, text: Column) -> Column:
        return lexical_score(F.lit(spec.entity), text, GATE_CHARS)

    def filters(self, spec, text: Column) -> Column:
        """A score for each filter that has words, over the beginning of the chunk that a judge sees."""
        return F.array(*(lexical_score(F.lit(f), text, FILTER_CHARS) for f in spec.filters)).cast("array<double>")

    def support(self, value: Column, evidence: Column) -> Column:
        return lexical_score(value, evidence, SUPPORT_CHARS)
