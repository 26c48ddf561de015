"""Line deduplication across documents within an edit bound.

Lines are compared as word sequences (parted by ASCII blanks). A line is dropped when an
earlier line, in order of document id and line number, is within the bound: the
same words, or one word replaced, inserted or deleted if the shorter of both has
at least ``min_words`` words. Lines without a word stay.

Method: same lines meet on a hash of their words. For the rest, each distinct
line emits its deletion neighbourhood: itself and every variant with one word
deleted, as hashed keys; variants of equal lines join, the edit distance of each line and the
earliest line of its bucket is verified, and the earliest line stays. A key
tells whether a word was deleted and where, so a bucket's lines are within the bound of
each other, and comparing with its earliest is enough; no pairs within a bucket
are made. Keys are sums of word hashes by position, so all variants of a line cost
time in proportion to its length.

Two lines one edit apart share the first or the last half of their words. Only lines
that share such a half with another line emit their neighbourhood, which loses nothing.

Fixed results: a null or empty text has no line; a document with a null id is not
compared and passes unchanged; rows are told apart by id and text: those equal in both are one document and
lose the same lines, those with one id and different texts are documents of their own, ordered by a hash of the text;
a document may become empty, its row stays; ties cannot occur between lines of different documents, but for two texts of one id
whose 31-bit order hashes are equal: of these neither counts as earlier. A very long line is one row while its words are compared;
other columns pass through; an empty table gives no row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import if_small, once, scratch, slim, staged

#: Lines of fewer words are compared for equality only: one edit in fewer words is another line. (Default of a parameter.)
MIN_WORDS = 10

_BLANK = r"[ \t\x0B\f\r]+"
_DISTINCT = ["h1", "h2"]


def _words(line: Column) -> Column:
    return F.filter(F.split(line, _BLANK), lambda w: w != "")


def _text_hash() -> Column:
    return F.xxhash64("text")


def _lines(docs: DataFrame) -> DataFrame:
    """``doc_id, part, h, line_no, line``: ``h`` tells texts of one id apart, ``part`` are its highest 31 bits."""
    rows = slim(docs, "doc_id", "text").where("doc_id IS NOT NULL AND text IS NOT NULL").select("doc_id", _text_hash().alias("h"), once(F.split("text", "\n", -1)).alias("lines"))
    return rows.select("doc_id", F.shiftrightunsigned("h", 33).cast("int").alias("part"), "h", F.posexplode("lines").alias("line_no", "line"))


#: Columns that name a line, in their order.
_PLACE = ["doc_id", "part", "line_no"]


def _order() -> Column:
    """The place of a line in the corpus as one number, which aggregates without sorting."""
    wide = lambda c: c.cast("decimal(20,0)")
    within = F.col("part").cast("long") * F.lit(1 << 31) + F.col("line_no")
    return (wide(F.col("doc_id")) * F.lit(1 << 62).cast("decimal(19,0)")).cast("decimal(38,0)") + wide(within)


def _placed(order: str, kind: str) -> list[Column]:
    """The columns that name the line of an order number."""
    within = f"cast(pmod({order}, 4611686018427387904) AS bigint)"
    doc = F.expr(f"({order} - pmod({order}, 4611686018427387904)) div 4611686018427387904").cast(kind)
    return [doc.alias("doc_id"), F.expr(f"cast(shiftright({within}, 31) AS int)").alias("part"), F.expr(f"cast({within} & 2147483647 AS int)").alias("line_no")]


def _keyed(docs: DataFrame, min_words: int) -> DataFrame:
    """Each line with a word: hashes of its words and of the halves that it shares with any line one edit apart."""
    rows = _lines(docs).select(*_PLACE, "h", once(_words(F.col("line"))).alias("w")).where("size(w) > 0")
    rows = rows.select("*", F.size("w").alias("n")).select("*", F.expr("n div 2").alias("a"), F.expr("(n - 1) div 2").alias("b"))
    half = lambda k, side: F.expr(f"CASE WHEN n >= {min_words} THEN xxhash64({k}, '{side}', " + (f"slice(w, 1, {k})" if side == "first" else f"slice(w, n - {k} + 1, {k})") + ") END")
    return rows.select(*_PLACE, "h", "n", F.expr("xxhash64(w)").alias("h1"), F.expr("xxhash64(n, w)").alias("h2"), half("a", "first").alias("k1"), half("a", "last").alias("k2"), half("b", "first").alias("k3"), half("b", "last").alias("k4"))


def _shared(rows: DataFrame, key: str, name: str) -> DataFrame:
    """The rows whose key stands in more than one row."""
    again = staged(rows.groupBy(key).count().where("count > 1").select(key), name)
    return rows.join(if_small(again), key, "left_semi")


def _variants(words: DataFrame) -> DataFrame:
    """``own`` lines and their deletion variants with hashed keys ``key``; ``role``: 0 for a line itself, 1 for a variant.

    ``at`` is the deleted word's place where the other line has a word there too (a replacement), and -1
    for keys by which a line meets the variant of a line that is one word longer.
    """
    g = lambda seed, place: F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.col("w"), place), 24)  # noqa: E731  40 bits: sums of 8 million words fit
    j = F.col("j")
    line = Window.partitionBy(*_PLACE, "h")
    upto = line.orderBy("j").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = words.select(*_PLACE, "h", "n", F.posexplode("w").alias("j", "w"))
    rows = rows.select("*", *(f(s, p).alias(f"{c}{s}") for s in (1, 2) for c, p, f in (("g", j, g), ("m", j - 1, g))))
    rows = rows.select("*", *(F.sum(f"g{s}").over(line).alias(f"all{s}") for s in (1, 2)), *(F.sum(f"g{s}").over(upto).alias(f"before{s}") for s in (1, 2)), *((F.sum(f"m{s}").over(line) - F.sum(f"m{s}").over(upto)).alias(f"after{s}") for s in (1, 2)))
    key = lambda at, n, a, b: F.struct(at.cast("int").alias("at"), n.cast("int").alias("len"), a.alias("x"), b.alias("y"))
    replaced = F.struct(F.lit(1).alias("role"), key(j, F.col("n"), F.col("all1") - F.col("g1"), F.col("all2") - F.col("g2")).alias("k"))
    shorter = F.struct(F.lit(1).alias("role"), key(F.lit(-1), F.col("n") - 1, F.col("before1") - F.col("g1") + F.col("after1"), F.col("before2") - F.col("g2") + F.col("after2")).alias("k"))
    whole = F.when(j == 0, F.struct(F.lit(0).alias("role"), key(F.lit(-1), F.col("n"), F.col("all1"), F.col("all2")).alias("k")))
    out = rows.select(*_PLACE, F.explode(F.array_compact(F.array(replaced, shorter, whole))).alias("v")).select(*_PLACE, "v.role", "v.k.*")
    return out.withColumn("key", F.xxhash64("at", "len", "x", "y"))


def within_one(a: Column, b: Column) -> Column:
    """Whether two word arrays are at most one word replaced, inserted or deleted apart."""
    same = lambda x, y: F.coalesce(F.array_position(F.zip_with(x, y, lambda p, q: p.eqNullSafe(q)), False), F.lit(0))
    first, last = same(a, b), same(F.reverse(a), F.reverse(b))
    longest = F.greatest(F.size(a), F.size(b))
    return (F.abs(F.size(a) - F.size(b)) <= 1) & ((first == 0) | ((first - 1) + (last - 1) >= longest - 1))


def dropped_lines(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """``doc_id, h, line_no`` of every line that has an earlier one within the bound; ``h`` is the text's hash."""
    kind = dict(docs.dtypes)["doc_id"]
    lines = staged(_keyed(docs, min_words), "lines")
    distinct = staged(lines.groupBy(*_DISTINCT).agg(F.min(_order()).alias("first"), F.count("*").alias("copies"), F.first("n").alias("n"), *(F.first(k).alias(k) for k in ("k1", "k2", "k3", "k4"))), "distinct")
    again = staged(distinct.where("copies > 1").select(*_DISTINCT, "first"), "again")
    exact = lines.join(if_small(again), _DISTINCT).where(_order() > F.col("first")).select("doc_id", "h", "line_no")

    halves = distinct.where(f"n >= {min_words}").select(*_placed("first", kind), F.explode(F.array_distinct(F.array("k1", "k2", "k3", "k4"))).alias("half"))
    near = staged(_shared(halves, "half", "halves").select(*_PLACE).distinct(), "near")
    words = staged(_lines(docs).join(if_small(near), _PLACE, "left_semi").dropDuplicates([*_PLACE, "h"]).select(*_PLACE, "h", _words(F.col("line")).alias("w")).withColumn("n", F.size("w")), "words")
    met = staged(_shared(_variants(words), "key", "variants"), "met").withColumn("o", _order())
    bucket = ["at", "len", "x", "y"]
    least = met.groupBy(*bucket).agg(F.min(F.when(F.col("role") == 0, F.col("o"))).alias("o0"), F.min(F.when(F.col("role") == 1, F.col("o"))).alias("o1"))
    # A replacement's bucket holds variants only; otherwise a line meets variants of longer lines, and these meet it.
    pairs = met.join(least, bucket).withColumn("first", F.when((F.col("at") >= 0) | (F.col("role") == 0), F.col("o1")).otherwise(F.col("o0"))).where("first < o")
    late_place = [f"{c}_late" for c in _PLACE]
    pairs = pairs.select(*(F.col(c).alias(f"{c}_late") for c in _PLACE), *_placed("first", kind)).distinct()
    early = words.select(*_PLACE, F.col("w").alias("early"))
    late = words.select(*(F.col(c).alias(f"{c}_late") for c in _PLACE), "h", F.col("w").alias("late"))
    close = pairs.join(early, _PLACE).join(late, late_place).where(within_one(F.col("early"), F.col("late")))
    return exact.unionByName(close.select(F.col("doc_id_late").alias("doc_id"), "h", F.col("line_no_late").alias("line_no"))).distinct()


def dedup_lines(docs: DataFrame, report: bool = False, min_words: int = MIN_WORDS) -> DataFrame:
    """The documents without their dropped lines. ``report`` adds ``n_lines`` and ``n_dropped``. Lines of fewer than ``min_words`` words go only when an earlier line has the same words."""
    with scratch(docs.sparkSession) as keep:
        drops = keep(staged(dropped_lines(docs, min_words).groupBy(F.col("doc_id").alias("__id"), F.col("h").alias("__h")).agg(F.sort_array(F.collect_set("line_no")).alias("__drops")), "drops"))
    joined = docs.join(if_small(drops), (docs["doc_id"] == F.col("__id")) & (F.xxhash64(docs["text"]) == F.col("__h")), "left")
    # What stays are the runs between dropped lines, so the work is in proportion to the lines.
    runs = """array_join(flatten(transform(sequence(0, size(__drops)), i -> slice(__lines,
        if(i = 0, 1, __drops[i - 1] + 2),
        if(i = size(__drops), size(__lines), __drops[i]) - if(i = 0, 0, __drops[i - 1] + 1)))), '\n')"""
    joined = joined.withColumn("__lines", F.when(F.col("__drops").isNotNull(), F.split("text", "\n", -1)))
    joined = joined.withColumn("text", F.when(F.col("__drops").isNull(), F.col("text")).otherwise(F.expr(runs)))
    if report:
        lines = F.when(F.col("__drops").isNotNull(), F.size("__lines")).otherwise(F.size(F.split("text", "\n", -1)))
        joined = joined.withColumn("n_lines", F.greatest(F.coalesce(lines, F.lit(0)), F.lit(0)).cast("long")).withColumn("n_dropped", F.coalesce(F.size("__drops"), F.lit(0)).cast("long"))
        joined = joined.withColumn("n_dropped", F.greatest("n_dropped", F.lit(0).cast("long")))
    elif "n_chars" in docs.columns:
        joined = joined.withColumn("n_chars", F.when(F.col("__drops").isNull(), F.col("n_chars")).otherwise(F.length("text")).cast(dict(docs.dtypes)["n_chars"]))
    return joined.drop("__id", "__h", "__drops", "__lines")


#: The report in DuckDB's SQL: each distinct line's earliest place, and for long lines a comparison of words with one left out.
ORACLE_SQL = r"""
WITH l AS (SELECT doc_id, unnest(generate_series(0, len(string_split(text, chr(10))) - 1)) AS line_no, unnest(string_split(text, chr(10))) AS line FROM documents WHERE doc_id IS NOT NULL),
w AS (SELECT doc_id, line_no, list_filter(regexp_split_to_array(line, '[ \t\x0B\f\r]+'), lambda x: x <> '') AS w FROM l),
o AS (SELECT *, row_number() OVER (ORDER BY doc_id, line_no) AS o FROM w WHERE len(w) > 0),
d AS (SELECT w, min(o) AS o, len(w) AS n FROM o GROUP BY w),
v AS MATERIALIZED (SELECT o, n, w, unnest(generate_series(1, n)) AS i FROM d WHERE n >= 10),
k AS MATERIALIZED (SELECT o, n, i, hash(list_concat(w[:i - 1], w[i + 1:])) AS key, list_concat(w[:i - 1], w[i + 1:]) AS rest FROM v),
near AS (
  SELECT b.o FROM k a JOIN k b ON a.key = b.key AND a.i = b.i AND a.n = b.n AND a.o < b.o AND a.rest = b.rest
  UNION SELECT k.o FROM k JOIN d ON k.key = hash(d.w) AND k.rest = d.w AND d.o < k.o AND d.n >= 10
  UNION SELECT d.o FROM k JOIN d ON k.key = hash(d.w) AND k.rest = d.w AND k.o < d.o AND d.n >= 10),
gone AS (SELECT doc_id, line_no FROM o JOIN d USING (w) WHERE o.o > d.o UNION SELECT doc_id, line_no FROM o JOIN near USING (o)),
left_ AS (SELECT l.doc_id, coalesce(string_agg(line, chr(10) ORDER BY l.line_no) FILTER (g.doc_id IS NULL), '') AS text, count(*) AS n_lines, count(g.doc_id) AS n_dropped
          FROM l LEFT JOIN gone g ON l.doc_id = g.doc_id AND l.line_no = g.line_no GROUP BY l.doc_id)
SELECT doc_id, text, CAST(n_lines AS BIGINT) AS n_lines, CAST(n_dropped AS BIGINT) AS n_dropped FROM left_
"""
