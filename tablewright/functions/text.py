"""String, number, date and URL functions: ``Column -> Column``, built-in expressions throughout."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Month names and their usual short forms, by number.
MONTHS = ("january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december")
MONTH_NUMBER = {m: i for i, m in enumerate(MONTHS, 1)} | {m[:3]: i for i, m in enumerate(MONTHS, 1)} | {"sept": 9}

# Magnitude words for a single value, and the smaller set for numbers inside a text.
MAGNITUDES = {"k": 1e3, "thousand": 1e3, "lakh": 1e5, "lakhs": 1e5, "m": 1e6, "mn": 1e6, "mm": 1e6, "million": 1e6, "cr": 1e7, "crore": 1e7, "crores": 1e7, "b": 1e9, "bn": 1e9, "billion": 1e9, "t": 1e12, "tn": 1e12, "trillion": 1e12}
TEXT_MAGNITUDES = {k: v for k, v in MAGNITUDES.items() if k not in ("mm", "t", "tn", "trillion")}

# Legal forms that are no part of a name, words around a number, elements without content.
LEGAL = r"\b(pvt\.?\s*ltd\.?|private\s+limited|pvt\s+limited|ltd\.?|limited|llp|llc|inc\.?|incorporated|corp\.?|corporation|co\.?|company|gmbh|s\.?a\.?|pte\.?\s*ltd\.?)\b"
AROUND_NUMBER = r"\b(?:usd|inr|rs\.?|dollars?|rupees?|parameters?|params?|approx\.?|approximately|about|around|over|nearly)\b|[~≈$₹€£]"
TAGLINE = r"\s*(?::|–|—| - | \| )\s*"
NO_CONTENT = ("script", "style", "noscript", "svg", "nav", "footer", "header")
PAGE_PARAMETERS = ("page", "p", "pg", "offset")

CHUNK_SIZE, CHUNK_OVERLAP = 8000, 200
RENDER_BELOW = 200


def lookup(table: dict, key: Column) -> Column:
    """The table's value for a key, as one CASE that the code generator handles."""
    out = F.lit(None)
    for i, (k, v) in enumerate(table.items()):
        out = F.when(key == k, F.lit(v)) if i == 0 else out.when(key == k, F.lit(v))
    return out


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once for each row, however often and in whichever branches the body uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def collapse(c: Column) -> Column:
    """Runs of blanks, with no-break spaces among them, as one space; none at the ends."""
    return F.trim(F.regexp_replace(c, r"(?U)\s+", " "))


def norm_text(c: Column, zero_is_empty: bool = False) -> Column:
    """Collapsed and lower-cased; null is the empty text. ``zero_is_empty`` is for columns of numbers or truth values, whose zero and false count as empty."""
    t = F.lower(collapse(F.coalesce(c.cast("string"), F.lit(""))))
    return F.when(t.isin("0", "0.0", "false"), "").otherwise(t) if zero_is_empty else t


def normalize_name(c: Column) -> Column:
    """The comparable form of an entity's name: no bracketed part, tagline, legal form or punctuation; 80 characters. Plain numbers need only their point replaced."""
    plain = c.cast("string")
    s = F.regexp_replace(F.lower(F.coalesce(c.cast("string"), F.lit(""))), r"\([^)]*\)", " ")
    head = F.split(s, TAGLINE, 2)[0]
    s = F.when(head == "", s).otherwise(head)
    s = F.regexp_replace(s, LEGAL, "")
    s = F.trim(F.regexp_replace(F.regexp_replace(s, "[^a-z0-9 ]", " "), " +", " "))
    named = F.coalesce(F.nullif(F.substring(s, 1, 80), F.lit("")), F.lit("unknown"))
    return F.when(plain.rlike(r"\A[0-9]{1,30}(\.[0-9]{1,30})?\z"), F.replace(plain, F.lit("."), F.lit(" "))).otherwise(named)


def years(c: Column) -> Column:
    """The distinct years from 1900 to 2099 that stand as words, sorted."""
    return F.array_sort(F.array_distinct(F.regexp_extract_all(c, F.lit(r"\b((?:19|20)\d{2})\b"), F.lit(1))))


def compact_key(c: Column) -> Column:
    """A key without its years and spaces."""
    return F.replace(F.regexp_replace(c, r"\b(19|20)\d{2}\b", ""), F.lit(" "), F.lit(""))


def url_domain(url: Column) -> Column:
    """Host of a URL with its port, without a leading ``www.``."""
    host = F.regexp_extract(F.lower(url), r"^[a-z][a-z0-9+.\-]*://([^/?#]*)", 1)
    return F.regexp_replace(host, r"^www\.", "")


def canonical_domain(url: Column) -> Column:
    """Host without ``www.`` and port; a missing scheme is taken as https; null for none."""
    full = F.when(F.contains(url, F.lit("://")), url).otherwise(F.concat(F.lit("https://"), url))
    return F.nullif(F.regexp_replace(url_domain(full), r":\d+$", ""), F.lit(""))


def same_domain(a: Column, b: Column) -> Column:
    return F.coalesce(canonical_domain(a) == canonical_domain(b), F.lit(False))


def norm_value(c: Column, kind: Column) -> Column:
    """A claim's comparable value by field type."""
    s = collapse(c.cast("string"))
    number = F.regexp_extract(F.replace(s, F.lit(","), F.lit("")), r"[\d,]+\.?\d*", 0)
    return F.when(kind == "url", F.regexp_replace(F.lower(F.trim(c.cast("string"))), "/+$", "")).when(kind == "number", F.when(number == "", F.lower(F.trim(c.cast("string")))).otherwise(number)).otherwise(F.lower(s))


def single_year(c: Column) -> Column:
    """The only distinct year of a text, or null."""
    found = F.array_distinct(F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(r"(?<!\d)((?:19|20)\d{2})(?!\d)"), F.lit(1)))
    return F.when(F.size(found) == 1, F.get(found, F.lit(0)).cast("int"))


def _month(token: Column) -> Column:
    """Two digits of a month's name, or null."""
    return F.lpad(lookup(MONTH_NUMBER, F.lower(token)).cast("string"), 2, "0")


def _day(token: Column) -> Column:
    """Two digits of a day with or without an ordinal ending, or null."""
    return F.lpad(F.nullif(F.regexp_extract(token, r"(?i)^(\d{1,2})(?:st|nd|rd|th)?$", 1), F.lit("")), 2, "0")


def _year(token: Column) -> Column:
    return F.when(token.rlike(r"^\d{4}$"), token)


def _worded_date(t: Column, hint: Column) -> Column:
    """A date from two or three words: day and month in either order with a year or the hint's, or month and year."""
    n, first, second = F.size(t), F.get(t, F.lit(0)), F.get(t, F.lit(1))
    bare = lambda x: F.regexp_replace(x, r"\.?,?$", "")
    year = F.when(n == 3, _year(F.get(t, F.lit(2)))).when(n == 2, hint)
    real = lambda m, d: F.date_format(F.try_to_date(F.concat(year, F.lit("-"), m, F.lit("-"), d), "yyyy-MM-dd"), "yyyy-MM-dd")
    behind = F.when(n == 3, F.regexp_replace(second, ",$", "")).otherwise(second)
    return F.coalesce(
        real(_month(bare(second)), _day(first)),
        real(_month(F.regexp_replace(first, r"\.$", "")), _day(behind)),
        F.when(n == 2, F.concat(_year(second), F.lit("-"), _month(bare(first)))),
    )


def normalize_date(c: Column, year_hint: Column | None = None) -> Column:
    """ISO date, month or year where the text is unambiguous; else the text as it is."""
    hint = year_hint.cast("string") if year_hint is not None else F.lit(None).cast("string")

    def iso(s: Column) -> Column:
        return (
            F.when(s.rlike(r"^\d{4}-\d{2}-\d{2}(?:[T ]|$)"), F.date_format(F.try_to_date(F.substring(s, 1, 10), "yyyy-MM-dd"), "yyyy-MM-dd"))
            .when(s.rlike(r"^\d{4}-\d{2}$"), F.when(F.substring(s, 6, 2).between("01", "12"), s))
            .when(s.rlike(r"^\d{4}$"), s)
            .otherwise(let(F.split(s, " "), lambda t: F.when(F.size(t).between(2, 3), _worded_date(t, hint))))
        )

    return F.coalesce(let(collapse(c), iso), c)


def normalize_number(c: Column) -> Column:
    """The number that a text is, with its magnitude word; null where the text is anything else and stays as it is."""
    shape = r"^(\d[\d,]*(?:\.\d+)?)\s*([a-z]+)?$"

    def scaled(s: Column) -> Column:
        digits = F.replace(F.regexp_extract(s, shape, 1), F.lit(","), F.lit("")).cast("double")
        return F.when(s.rlike(shape), let(F.regexp_extract(s, shape, 2), lambda word: digits * F.when(word == "", F.lit(1.0)).otherwise(lookup(MAGNITUDES, word))))

    return let(collapse(F.regexp_replace(F.lower(c), AROUND_NUMBER, " ")), scaled)


def number_text(n: Column) -> Column:
    """A number as text, without a fraction if it is whole within a millionth."""
    return F.when(F.abs(n - F.round(n)) < 1e-6, F.format_string("%.0f", F.round(n))).otherwise(n.cast("string"))


def normalize_value(c: Column, kind: Column, year_hint: Column | None = None) -> Column:
    """By field type; other types, null and the empty text pass."""
    number = F.coalesce(number_text(normalize_number(c)), c)
    return F.when(c.isNull() | (c == ""), c).when(kind == "date", normalize_date(c, year_hint)).when(kind == "number", number).otherwise(c)


# What narrows a search, in the order in which it is taken out.
NARROWING = (r"(?i)\bsite:\S+", r'["“”]', r"\b(AND|OR|NOT)\b", r"(^|\s)-\w+")


def relax_query(c: Column) -> Column:
    """A search query without the operators that narrow it."""
    for pattern in NARROWING:
        c = F.regexp_replace(c, pattern, " ")
    return collapse(c)


def dedupe_consecutive(lines: Column) -> Column:
    """An array without the elements that equal the one before them."""
    return F.filter(F.arrays_zip(lines.alias("line"), F.concat(F.array(F.lit(None).cast("string")), lines).alias("before")), lambda x: x["line"].isNotNull() & ~x["line"].eqNullSafe(x["before"]))["line"]


def clean_html(html: Column) -> Column:
    """Text lines of a page: no elements without content, no markup, trimmed, no blank or immediately repeated lines."""
    s = F.regexp_replace(html, rf"(?is)<({'|'.join(NO_CONTENT)})\b[^>]*>.*?</\1\s*>", "\n")
    s = F.regexp_replace(F.regexp_replace(s, r"(?s)<!--.*?-->", "\n"), r"<[^>]+>", "\n")
    for name, char in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        s = F.replace(s, F.lit(name), F.lit(char))
    lines = F.filter(F.transform(F.split(s, r"[\n\r]+"), lambda x: F.trim(F.regexp_replace(x, r"^[\s\xA0]+|[\s\xA0]+$", ""))), lambda x: x != "")
    return F.array_join(dedupe_consecutive(lines), "\n")


def needs_render(text: Column) -> Column:
    return F.length(text) < RENDER_BELOW


def chunks(text: Column, size: int = CHUNK_SIZE, overlap: int = CHUNK_OVERLAP) -> Column:
    """Overlapping chunks; the last may lie inside the one before it."""
    if not 0 <= overlap < size:
        raise ValueError("the overlap must be smaller than the chunk")
    starts = F.sequence(F.lit(0), F.greatest(F.length(text) - 1, F.lit(0)), F.lit(size - overlap))
    return F.when(F.length(text) <= size, F.array(text)).otherwise(F.transform(starts, lambda s: F.substr(text, s + 1, F.lit(size))))


def next_page_url(url: Column) -> Column:
    """The URL with its first page parameter one higher, or null. Keeps the first value of each parameter."""
    out = F.lit(None).cast("string")
    for name in reversed(PAGE_PARAMETERS):
        shape = rf"([?&]{name}=)(\d+)(?=&|#|$)"
        number = (F.regexp_extract(url, shape, 2).try_cast("long") + 1).cast("string")
        moved = F.concat(F.regexp_extract(url, rf"^(.*?[?&]{name}=)\d+(?=&|#|$)", 1), number, F.regexp_extract(url, rf"^.*?[?&]{name}=\d+((?:&|#|$).*)$", 1))
        out = F.when(url.rlike(shape), moved).otherwise(out)
    return out


def absolute_url(href: Column, base: Column) -> Column:
    """A link's address as seen from the page ``base``."""
    origin = F.regexp_extract(base, r"^([a-zA-Z][a-zA-Z0-9+.\-]*://[^/?#]*)", 1)
    scheme = F.regexp_extract(base, r"^([a-zA-Z][a-zA-Z0-9+.\-]*:)", 1)
    page = F.regexp_extract(base, r"^([^?#]*)", 1)
    folder = F.regexp_replace(F.when(page == origin, F.concat(page, F.lit("/"))).otherwise(page), r"[^/]*$", "")
    return (
        F.when(href.rlike(r"^[a-zA-Z][a-zA-Z0-9+.\-]*:"), href)
        .when(F.startswith(href, F.lit("//")), F.concat(scheme, href))
        .when(F.startswith(href, F.lit("/")), F.concat(origin, href))
        .when(F.startswith(href, F.lit("?")), F.concat(page, href))
        .when(F.startswith(href, F.lit("#")), F.concat(F.regexp_extract(base, r"^([^#]*)", 1), href))
        .otherwise(F.concat(folder, F.regexp_replace(href, r"^(\./)+", "")))
    )


def next_link(html: Column, url: Column) -> Column:
    """The next page: a link or anchor marked as next, an anchor that reads so, else the page parameter one higher."""
    found = [F.regexp_extract(html, p, 1) for p in (
        r"""(?is)<link\b(?=[^>]*\brel\s*=\s*["'][^"']*\bnext\b)[^>]*?\bhref\s*=\s*["']([^"']+)["']""",
        r"""(?is)<a\b(?=[^>]*\brel\s*=\s*["'][^"']*next)[^>]*?\bhref\s*=\s*["']([^"']+)["']""",
        r"""(?is)<a\b[^>]*?\bhref\s*=\s*["']([^"']+)["'][^>]*>\s*(?:next|next »|next →|›|»)\s*</a""",
    )]
    href = F.coalesce(*(F.nullif(f, F.lit("")) for f in found))
    return F.when(href.isNotNull(), absolute_url(href, url)).otherwise(next_page_url(url))


def tokens(c: Column) -> Column:
    return F.regexp_extract_all(c, F.lit("([a-z0-9]+)"), F.lit(1))


_IN_TEXT = rf"(\d[\d,]*(?:\.\d+)?)\s*({'|'.join(sorted(TEXT_MAGNITUDES, key=len, reverse=True))})?(?![a-z])"


def numbers_in(c: Column) -> Column:
    """Every number of a lower-case text with its magnitude word."""
    pairs = F.arrays_zip(F.regexp_extract_all(c, F.lit(_IN_TEXT), F.lit(1)).alias("n"), F.regexp_extract_all(c, F.lit(_IN_TEXT), F.lit(2)).alias("w"))
    return F.transform(pairs, lambda p: F.replace(p["n"], F.lit(","), F.lit("")).cast("double") * F.coalesce(lookup(TEXT_MAGNITUDES, p["w"]), F.lit(1.0)))


def quote_on_page(quote: Column, page: Column) -> Column:
    """Whether the page holds the quote, blanks and case aside."""
    needle = F.lower(collapse(F.coalesce(quote, F.lit(""))))
    return (needle != "") & F.contains(F.lower(F.regexp_replace(F.coalesce(page, F.lit("")), r"(?U)\s+", " ")), needle)


def _edged(c: Column) -> Column:
    """A lower-case text with a mark at each end of each run of letters and digits."""
    return F.regexp_replace(c, "([a-z0-9]+)", "\u0001$1\u0001")


def value_in_quote(value: Column, quote: Column) -> Column:
    """Whether a quote backs a value: as whole token, with all its tokens, or as the same quantity within half a percent."""

    def whole(v: Column, q: Column) -> Column:
        # Marks make a run's ends part of the text, so whole tokens are found without a pattern for each row.
        literal = F.concat(F.lit(r"(?<![a-z0-9])\Q"), F.replace(v, F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E(?![a-z0-9])"))
        return (v != "") & F.contains(q, v) & F.when(v.rlike("^[a-z0-9](?:.*[a-z0-9])?$"), F.contains(_edged(q), _edged(v))).otherwise(F.regexp_like(q, literal))

    def parts(v: Column, q: Column) -> Column:
        return let(tokens(v), lambda t: (F.size(t) > 0) & (F.size(F.array_except(t, tokens(q))) == 0))

    def close(v: Column, q: Column) -> Column:
        same = lambda n, m: F.abs(n - m) <= 0.005 * F.greatest(F.abs(n), F.lit(1e-9))
        return let(numbers_in(v), lambda mine: (F.size(mine) == 1) & F.exists(numbers_in(q), lambda n: same(n, F.get(mine, F.lit(0)))))

    v, q = F.lower(collapse(value.cast("string"))), F.lower(F.regexp_replace(quote, r"(?U)\s+", " "))
    return F.coalesce((quote != "") & let(F.struct(v.alias("v"), q.alias("q")), lambda x: whole(x["v"], x["q"]) | parts(x["v"], x["q"]) | close(x["v"], x["q"])), F.lit(False))


def build_premise(quote: Column, context: Column) -> Column:
    q, c = collapse(F.coalesce(quote, F.lit(""))), collapse(F.coalesce(context, F.lit("")))
    return F.substring(F.when(c != "", F.concat(F.substring(c, 1, 300), F.lit(" ... "), q)).otherwise(q), 1, 600)


def build_hypothesis(entity: Column, description: Column, value: Column) -> Column:
    return F.concat(F.lit("The "), description, F.lit(" of "), entity, F.lit(" is "), value, F.lit("."))


def logit(p: Column) -> Column:
    q = F.least(F.greatest(p, F.lit(0.01)), F.lit(0.99))
    return F.ln(q / (1 - q))


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def softmax(scores: Column) -> Column:
    shifted = F.transform(scores, lambda x: F.exp(x - F.array_max(scores)))
    return F.transform(shifted, lambda x: x / F.aggregate(shifted, F.lit(0.0), lambda a, b: a + b))


def probability_answer(answer: Column) -> Column:
    """The probability of a typed JSON answer, or null."""
    return F.when(F.get_json_object(answer, "$.type") == "noul", F.get_json_object(answer, "$.noul").try_cast("double"))


def choice_answer(answer: Column) -> Column:
    return F.when(F.get_json_object(answer, "$.type") == "choice", F.get_json_object(answer, "$.choice"))


def error_message(raw: Column) -> Column:
    """The readable message of an error text: of a JSON object in it, else the text itself."""
    held = F.regexp_extract(raw, r"(?s)(\{.*\})", 1)
    held = F.when(F.is_valid_utf8(held) & (held != ""), held)
    message = F.get_json_object(held, "$.error.message")
    failed = F.nullif(F.trim(F.get_json_object(held, "$.error.failed_generation")), F.lit(""))
    clean = F.trim(F.replace(message, F.lit(" See 'failed_generation' for more details."), F.lit("")))
    with_failed = F.when(clean == "", failed).otherwise(F.concat(clean, F.lit(" ("), failed, F.lit(")")))
    plain = F.get_json_object(held, "$.error")
    named = F.when(message.isNotNull(), F.when(failed.isNotNull(), with_failed).otherwise(F.trim(message)))
    other = F.when(plain.isNotNull() & ~F.startswith(plain, F.lit("{")), F.trim(plain))
    return F.coalesce(named, other, F.trim(F.get_json_object(held, "$.message")), F.nullif(F.trim(raw), F.lit("")), F.lit("An unexpected pipeline error occurred."))
