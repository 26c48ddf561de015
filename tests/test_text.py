"""Values that the functions must give, one list for each function."""

import pytest
from pyspark.sql import functions as F

from tablewright.functions import text as X
from tablewright.functions import web


def results(spark, values, function):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r[0] for r in rows.orderBy("i").select(function(F.col("v"))).collect()]


@pytest.mark.parametrize("hint, cases", [
    (None, {"10 July 2025": "2025-07-10", "July 10, 2025": "2025-07-10", "May 2024": "2024-05", "2025-12-01T10:00:00Z": "2025-12-01", "2024": "2024", "Jan 20": "Jan 20", "01/02/2025": "01/02/2025", "Feb 30 2025": "Feb 30 2025", "3rd Sept. 2021": "2021-09-03", "2025-13": "2025-13", "": ""}),
    (2025, {"Jan 20": "2025-01-20", "20th January": "2025-01-20", "Jan 20 2019": "2019-01-20"}),
])
def test_dates(spark, hint, cases):
    assert results(spark, list(cases), lambda c: X.normalize_date(c, F.lit(hint))) == list(cases.values())


def test_numbers(spark):
    cases = {"671B": 671e9, "₹2.5 crore": 25e6, "1,250": 1250, "$4 million": 4e6, "approx 3 lakh": 3e5, "approx. 3 lakh": None, "7B/70B": None, "3.0.14": None, "45%": None, "about a dozen": None}
    assert results(spark, list(cases), X.normalize_number) == list(cases.values())


def test_single_year(spark):
    assert results(spark, ["in 2024", "2023 and 2024", "none", "2024, 2024", "x12024"], X.single_year) == [2024, None, None, 2024, None]


def test_names(spark):
    values = ["Acme Pvt. Ltd.", "ACME", "Acme (AC) ", "Qwen 2.5-VL: a model", "Ünï", "", "A" * 100]
    assert results(spark, values, X.normalize_name) == ["acme", "acme", "acme", "qwen 2 5 vl", "n", "unknown", "a" * 80]


def test_relax_query(spark):
    assert results(spark, ['"open data" site:example.org AND census -draft', "plain words"], X.relax_query) == ["open data census", "plain words"]


def test_value_in_quote(spark):
    cases = [("4000000", "raised $4 million", True), ("gold", "Silver sponsors: Acme", False), ("4M", "4 mn users", True), ("cat", "concatenate", False), ("new york", "york is new", True), ("a.b", "x a.b y", True), ("\\E", "q \\E q", True), (None, "x", False), ("x", "", False)]
    rows = spark.createDataFrame([(i, v, q, e) for i, (v, q, e) in enumerate(cases)], "i int, v string, q string, e boolean").orderBy("i")
    assert [r[0] for r in rows.select(X.value_in_quote(F.col("v"), F.col("q"))).collect()] == [e for *_, e in cases]


def test_quote_on_page_takes_no_break_spaces_as_blanks(spark):
    rows = spark.createDataFrame([("Big  news", "the big   NEWS today"), ("", "x"), (None, "x")], "q string, p string")
    assert [r[0] for r in rows.select(X.quote_on_page(F.col("q"), F.col("p"))).collect()] == [True, False, False]


def test_chunks(spark):
    sizes = [0, 8000, 8001, 15600, 15601, 15801]
    got = results(spark, ["x" * n for n in sizes], X.chunks)
    assert [[len(c) for c in g] for g in got] == [[0], [8000], [8000, 201], [8000, 7800], [8000, 7801, 1], [8000, 8000, 201]]
    with pytest.raises(ValueError):
        X.chunks(F.lit("x"), 10, 10)


def test_clean_html(spark):
    page = "<head><style>p{}</style></head><nav>menu</nav><p>One&nbsp;</p><p>One</p> <p>Two &amp; three</p><!-- c --><script>1</script><p>One</p>"
    assert results(spark, [page], X.clean_html) == ["One\nTwo & three\nOne"]


def test_next_page(spark):
    assert results(spark, ["http://a.b/c?q=1&page=2#x", "http://a.b/?p=9", "http://a.b/", "http://a.b/?page=x"], X.next_page_url) == ["http://a.b/c?q=1&page=3#x", "http://a.b/?p=10", None, None]


def test_addresses(spark):
    bad = ["127.0.0.1", "10.0.0.1", "172.16.0.1", "192.168.1.1", "169.254.169.254", "::1", "fc00::1", "fe80::1", "::ffff:8.8.8.8", "2002:808:808::1"]
    assert [web.is_public(a) for a in [*bad, "8.8.8.8", "2606:4700::1111", "no"]] == [False] * 10 + [True, True, False]


def test_compliance(spark):
    urls = ["https://in.linkedin.com/x", "https://a.x.com./", "ftp://a.b", "nothing", "https://u:p@a.b/", "https://a.b:0/", "https://a.b/c"]
    got = results(spark, urls, web.compliance_reason)
    assert [bool(g) for g in got] == [True] * 6 + [False] and "deny list" in got[1] and "credentials" in got[4]


def test_decode(spark):
    rows = spark.createDataFrame([(bytearray(b"it\x92s"), None), (bytearray("é".encode()), None), (bytearray(b"\xe9"), "latin-1"), (None, None)], "b binary, c string")
    assert [r[0] for r in rows.select(web.decode_bytes("b", "c")).collect()] == ["it’s", "é", "é", None]


def test_next_links(spark):
    base = "https://a.b/c/d?x=1"
    cases = {
        '<link href="/n" rel="next">': "https://a.b/n", '<a rel="next" href="e">x</a>': "https://a.b/c/e", '<a href="?page=2"> Next </a>': "https://a.b/c/d?page=2",
        '<a href="//o.p/q">»</a>': "https://o.p/q", '<a href="http://z/">next</a>': "http://z/", "<a href='k'>nextdoor</a>": None,
    }
    assert results(spark, list(cases), lambda c: X.next_link(c, F.lit(base))) == list(cases.values())
    assert results(spark, ["<p>"], lambda c: X.next_link(c, F.lit("https://a.b/?p=3"))) == ["https://a.b/?p=4"]
    assert results(spark, ["x"], lambda c: X.absolute_url(c, F.lit("https://a.b"))) == ["https://a.b/x"]


def test_robots(spark):
    body = "User-agent: *\nDisallow: /private"
    rows = spark.createDataFrame([(body, 200, "https://a.b/private/x"), (body, 200, "https://a.b/open"), (body, 503, "https://a.b/private/x"), (None, None, "https://a.b/private"), ("", 200, None)], "b string, s int, u string")
    assert [r[0] for r in rows.select(web.robots_allow("b", "s", "u", F.lit("bot"))).collect()] == [False, True, True, True, False]


def test_errors(spark):
    cases = {"Error: {'error': {'message': 'bad thing '}}": "bad thing", '{"error": "flat"}': "flat", "plain ": "plain", "": "An unexpected pipeline error occurred.", "odd {x} text": "odd {x} text", '{"message": "m"}': "m"}
    assert results(spark, list(cases), lambda c: X.error_message(web.literal_as_json(c))) == list(cases.values())
