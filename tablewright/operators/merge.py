"""Keyed ordered merge of claims into records, and the other first- and last-write tables.

The merge has a closed form over windows, so no fold over a key's claims is needed. Per cell, ordered by ``seq`` and without empty values:
claims that agree with the first are kept where their URL differs from the agreeing claim's before; the last of these gives the value;
the one before it corroborates; disagreeing claims of other URLs after it are its conflicts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import norm_text


def keys(rows: DataFrame, *names: str) -> list[str]:
    """The key columns that a table has. One that holds several runs has ``run`` among them, and nothing is merged across runs."""
    return [c for c in ("run", *(names or ("entity", "field"))) if c in rows.columns]


def by_cell(claims: DataFrame) -> DataFrame:
    """Claims parted by run and entity: all windows and groups of these, of cells and of what lies in them do without another shuffle."""
    return claims.repartition(*keys(claims, "entity"))


def marked(claims: DataFrame, keep_conflicts: bool = False) -> DataFrame:
    """Claims parted by cell with ``e``, the one that gives their cell its value, and whether each is ``against`` it; empty values are marked by neither."""
    key = keys(claims)
    more = [c for c in ("verified", "found") if c in claims.columns]
    rows = claims.withColumn("filled", F.coalesce(F.col("value") != "", F.lit(False))).withColumn("n", norm_text(F.col("value")))
    whole = Window.partitionBy(*key, "filled")
    cell = whole.orderBy("seq")
    rows = rows.withColumn("agrees", F.col("filled") & (F.col("n") == F.first("n").over(cell)))
    before = F.lag("url").over(Window.partitionBy(*key, "filled", "agrees").orderBy("seq"))
    first = F.row_number().over(cell) == 1
    rows = rows.withColumn("before", before).withColumn("effective", F.col("agrees") & (first | ((F.coalesce("url", F.lit("")) != F.coalesce("before", F.lit(""))) & (F.coalesce("before", F.lit("")) != ""))))
    last = F.max(F.when(F.col("effective"), F.struct("seq", "value", "url", F.col("before").alias("corroborated_by"), *more))).over(whole)
    rows = rows.withColumn("e", last)
    against = F.col("filled") & ~F.col("agrees") & (F.lit(keep_conflicts) | (F.col("seq") > F.col("e.seq"))) & (F.coalesce("url", F.lit("")) != F.coalesce("e.url", F.lit(""))) & (F.coalesce("e.url", F.lit("")) != "")
    return rows.withColumn("against", against).drop("filled", "n", "agrees", "before", "effective")


def conflict_list() -> Column:
    """The conflicts among marked claims, not yet in order."""
    return F.collect_list(F.when(F.col("against"), F.struct("seq", "url", "value")))


def merged(cells: DataFrame, key: list[str], *more: str) -> list[Column]:
    """A cell's columns from its ``e`` and its list ``c`` of conflicts."""
    passed = [f"e.{c}" for c in ("verified", "found") if c in cells.schema["e"].dataType.names]
    return [*map(F.col, key), F.col("e.value"), F.col("e.url"), F.col("e.corroborated_by"), F.transform(F.array_sort("c"), lambda x: F.struct(x["url"].alias("url"), x["value"].alias("value"))).alias("conflicts"), *map(F.col, passed), *map(F.col, more)]


def upsert_records(claims: DataFrame, keep_conflicts: bool = False, found: bool = False) -> DataFrame:
    """``run, entity, field, value, url, corroborated_by, conflicts`` from claims ``run, entity, field, seq, value, url`` (the run may be absent).

    ``keep_conflicts`` also reports the conflicts that a later corroboration would discard. A column ``verified`` passes from the claim that gives the value.
    ``found`` adds the earliest ``seq`` of a run's entity, claims without a value among them.
    """
    key = keys(claims)
    rows = by_cell(claims)
    if found:
        rows = rows.withColumn("found", F.min("seq").over(Window.partitionBy(*keys(claims, "entity"))))
    rows = marked(rows.where("value IS NOT NULL AND value <> ''"), keep_conflicts)
    out = rows.groupBy(*key).agg(F.first("e").alias("e"), conflict_list().alias("c"))
    return out.select(*merged(out, key))


def records(cells: DataFrame, fields: list[str] | None = None) -> DataFrame:
    """One row for each run and entity: id, fields and provenance as maps, and with the spec's ``fields`` their sourced share."""
    key = keys(cells, "entity")
    prov = F.struct(*(c for c in ("url", "corroborated_by", "conflicts", "verified", "kbt_prob", "conflict_note") if c in cells.columns))
    found = [F.min("found").alias("found")] if "found" in cells.columns else []
    rows = cells.groupBy(*key).agg(F.map_from_entries(F.collect_list(F.struct("field", "value"))).alias("fields"), F.map_from_entries(F.collect_list(F.struct("field", prov))).alias("provenance"), *found)
    rows = rows.withColumn("id", F.substring(F.concat_ws(":", *key), 1, 120))
    return rows.join(fields_sourced(cells, len(fields)), key) if fields is not None and "verified" in cells.columns else rows


def first_write(rows: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """The first row of each key: an insert that ignores later ones."""
    return rows.withColumn("__r", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where("__r = 1").drop("__r")


def source_ledger(visits: DataFrame) -> DataFrame:
    """Ledger by ``run, capture, url``: the first status stays; ``status_final`` is the last one's. A visit without a capture has a row of its own."""
    key = F.substring(F.concat_ws(":", F.col("run"), F.coalesce(F.nullif(F.col("capture"), F.lit("")), F.hex("seq")), F.col("url")), 1, 220)
    rows = visits.withColumn("id", key)
    last = rows.groupBy("id").agg(F.max_by("status", "seq").alias("status_final"))
    return first_write(rows, ["id"], ["seq"]).join(last, "id")


def label_upsert(labels: DataFrame) -> DataFrame:
    """The last judgement of each claim with the time of the first."""
    return labels.groupBy("claim_id").agg(F.max_by(F.struct("correct", "labeler"), "seq").alias("l"), F.min("created_at").alias("created_at")).select("claim_id", "l.correct", "l.labeler", "created_at")


def fields_sourced(cells: DataFrame, fields: int | None = None) -> DataFrame:
    """Share of an entity's fields that are verified, in hundredths rounded half up on whole numbers: of the spec's number of ``fields``, or of those present."""
    key = keys(cells, "entity")
    counts = cells.groupBy(*key).agg(F.count_if(F.col("verified")).alias("v"), (F.count("*") if fields is None else F.lit(max(fields, 1)).cast("long")).alias("n"))
    return counts.select(*key, (F.expr("(200 * v + n) div (2 * n)") / 100).alias("fields_sourced"))


def export_rows(cells: DataFrame, fields: list[str]) -> DataFrame:
    """One row for each run and entity: a column for each field, the sourced share where cells tell what is ``verified``, sorted sources, and whether any cell has conflicts."""
    key = keys(cells, "entity")
    wide = [F.coalesce(F.first(F.when(F.col("field") == f, F.col("value")), ignorenulls=True), F.lit("")).alias(f) for f in fields]
    n = max(len(fields), 1)
    sourced = [(F.expr(f"(200 * count_if(verified) + {n}) div {2 * n}") / 100).alias("fields_sourced")] if "verified" in cells.columns else []
    sources = F.array_join(F.array_sort(F.collect_set(F.nullif(F.col("url"), F.lit("")))), "; ").alias("sources")
    return cells.groupBy(*key).agg(*wide, *sourced, sources, F.max(F.when(F.size("conflicts") > 0, "yes").otherwise("")).alias("has_conflict"))
