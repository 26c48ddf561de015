"""Entity resolution: keys, matching of keys that name the same entity, groups and components."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import compact_key, normalize_name, years


def entity_keys(rows: DataFrame, name: str) -> DataFrame:
    return rows.withColumn("entity_key", normalize_name(F.col(name)))


def match_existing_key(keys: DataFrame) -> DataFrame:
    """``run, key, canonical``: each key's earliest key with the same compact form and years that do not contradict, from ``run, key, seq`` (the run may be absent).

    Equal compact forms meet on a hash join; within one, only the earliest key of each set of years is compared, of
    which there are few. Keys are compared with all earlier ones, so the result does not hang on an order of work.
    """
    run = [c for c in ("run",) if c in keys.columns]
    seen = keys.groupBy(*run, "key").agg(F.min("seq").alias("seq")).withColumn("compact", compact_key(F.col("key"))).withColumn("ys", years(F.col("key")))
    first = seen.groupBy(*run, "compact", "ys").agg(F.min_by("key", "seq").alias("other"), F.min("seq").alias("other_seq"))
    named = seen.where("compact <> ''").join(first.withColumnRenamed("ys", "other_ys"), [*run, "compact"])
    fits = (F.size("ys") == 0) | (F.size("other_ys") == 0) | (F.col("ys") == F.col("other_ys"))
    best = named.where(fits & (F.col("other_seq") <= F.col("seq"))).groupBy(*run, "key").agg(F.min_by("other", "other_seq").alias("canonical"))
    return seen.select(*run, "key").join(best, [*run, "key"], "left").select(*run, "key", F.coalesce("canonical", "key").alias("canonical"))


def group_by_entity(rows: DataFrame, name: str, order: str) -> DataFrame:
    """Groups of an entity: number of rows, first spelling, distinct spellings in order."""
    keyed = entity_keys(rows, name)
    spellings = keyed.groupBy("entity_key", name).agg(F.min(order).alias("o"), F.count("*").alias("n"))
    return spellings.groupBy("entity_key").agg(F.sum("n").alias("n_rows"), F.min_by(name, "o").alias("first_name"), F.count("*").alias("n_spellings"))


def components(edges: DataFrame) -> DataFrame:
    """``node, root``: the smallest node of each connected component of edges ``a, b``: neighbours' labels, hooked and jumped until nothing moves."""
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v"))).distinct().checkpoint()
    labels = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("root"))
    while True:
        ends = both.join(labels.select(F.col("u").alias("v"), F.col("root").alias("to")), "v").join(labels, "u").where("to < root")
        hooks = ends.select(F.explode(F.array("u", "root")).alias("u"), "to").groupBy("u").agg(F.min("to").alias("to"))
        hooked = labels.join(hooks, "u", "left").select("u", F.least("root", "to").alias("root"), F.col("root").alias("was"))
        jumped = hooked.join(hooked.select(F.col("u").alias("root"), F.col("root").alias("next")), "root", "left")
        labels = jumped.select("u", F.least("root", "next").alias("root"), (F.least("root", "next") < F.col("was")).alias("moved")).checkpoint()
        if labels.where("moved").isEmpty():
            return labels.select(F.col("u").alias("node"), "root")
        labels = labels.drop("moved")


def earliest_per_key(rows: DataFrame, key: str, order: str) -> DataFrame:
    """The first row of each key: URL deduplication in which the first title stays."""
    return rows.withColumn("__r", F.row_number().over(Window.partitionBy(key).orderBy(order))).where("__r = 1").drop("__r")
