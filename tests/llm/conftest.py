import pytest
from pyspark.sql import functions as F

PROSE = "the quick brown fox jumps over the lazy dog while many small birds sing in green trees near a quiet river at noon"
LONG = " ".join(f"word{i % 977} {i}" for i in range(30_000))

#: Ids, texts and sources with nulls, blanks, very long, repeated and odd ones.
EDGE = [
    (None, "a text without an id\nsecond line", "s1"),
    (1, None, "s1"),
    (2, "", None),
    (3, " \t\n\x0b ", "s2"),
    (4, PROSE, "s1"),
    (4, PROSE, "s1"),
    (5, PROSE + " again", "s2"),
    (6, LONG, "s2"),
    (7, "ünïcödé — 中文 🙂   nbsp em  two  blanks \n\n\n line", "s3"),
    (8, "one", "s3"),
    (9, "one", None),
    (-3, PROSE, "s9"),
    (10, "\0 nul <|endoftext|> and " + "x" * 5000, "s3"),
    (4, "another text under an id that is there twice\n" + PROSE, "s1"),
    (None, "a second text without an id", None),
]
#: Columns whose names the operators use inside.
CLASHING = ["fp", "key", "h", "n", "w", "b", "a", "part", "ids", "votes", "src", "block", "stratum", "line", "lines", "path", "features", "score", "root", "u", "start", "range", "kept", "group", "value", "first"]


@pytest.fixture(scope="session")
def edge(spark):
    df = spark.createDataFrame([(i, t, "en" if k % 3 else None, s, len(t or "")) for k, (i, t, s) in enumerate(EDGE)], "doc_id long, text string, lang string, source string, n_chars long")
    return df.withColumns({c: F.lit(f"extra {c}") for c in CLASHING})


@pytest.fixture(scope="session")
def empty(edge):
    return edge.limit(0)


@pytest.fixture(scope="session")
def marks(spark):
    return spark.createDataFrame([(i, i % 2, (i + 1) % 2) for i in range(4, 9)] + [(None, 1, 1), (4, None, None), (77, 1, 0)], "doc_id long, quality int, toxic int")


@pytest.fixture(scope="session")
def small(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
