"""DuckDB SQL for the registered queries, written apart from the operators."""

from __future__ import annotations

from ..functions.text import AROUND_NUMBER, LEGAL, MAGNITUDES, MONTH_NUMBER, NO_CONTENT, TEXT_MAGNITUDES
from ..functions.web import DENY
from ..sources.tables import QUOTE, QUOTED_VALUE, RAW_DATE, RAW_NAME, RAW_NUMBER, RAW_QUERY, RAW_TEXT


def _ws(x: str) -> str:
    return f"trim(regexp_replace({x}, '\\s+', ' ', 'g'))"


def _name(x: str) -> str:
    s = f"regexp_replace(lower(coalesce({x}, '')), '\\([^)]*\\)', ' ', 'g')"
    head = f"regexp_split_to_array({s}, '\\s*(?::|–|—| - | \\| )\\s*')[1]"
    s = f"coalesce(nullif({head}, ''), {s})"
    s = f"regexp_replace({s}, '{LEGAL}', '', 'g')"
    s = f"trim(regexp_replace(regexp_replace({s}, '[^a-z0-9 ]', ' ', 'g'), ' +', ' ', 'g'))"
    return f"coalesce(nullif(left({s}, 80), ''), 'unknown')"


def _case(x: str, table: dict) -> str:
    return f"CASE {x} " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in table.items()) + " END"


def _compact(x: str) -> str:
    return f"replace(regexp_replace({x}, '\\b(19|20)\\d{{2}}\\b', '', 'g'), ' ', '')"


def _domain(x: str) -> str:
    return f"regexp_replace(regexp_extract(lower({x}), '^[a-z][a-z0-9+.\\-]*://([^/?#]*)', 1), '^www\\.', '')"


def _canonical(x: str) -> str:
    return f"nullif(regexp_replace({_domain(f'CASE WHEN contains({x}, chr(58) || chr(47) || chr(47)) THEN {x} ELSE concat(chr(104) || chr(116) || chr(116) || chr(112) || chr(115) || chr(58) || chr(47) || chr(47), {x}) END')}, ':\\d+$', ''), '')"


_MONTH = "|".join(sorted(MONTH_NUMBER, key=len, reverse=True))
_DMY = f"(?i)^(\\d{{1,2}})(?:st|nd|rd|th)?\\s+({_MONTH})\\.?,?(?:\\s+(\\d{{4}}))?$"
_MDY = f"(?i)^({_MONTH})\\.?\\s+(\\d{{1,2}})(?:st|nd|rd|th)?(?:,?\\s+(\\d{{4}}))?$"
_MY = f"(?i)^({_MONTH})\\.?,?\\s+(\\d{{4}})$"


def _date(x: str, hint: str) -> str:
    s = _ws(x)
    part = lambda p, i: f"regexp_extract({s}, '{p}', {i})"
    month = lambda e: f"lpad(CAST({_case(f'lower({e})', MONTH_NUMBER)} AS VARCHAR), 2, '0')"
    real = lambda y, m, d: f"CAST(TRY_CAST({y} || '-' || {m} || '-' || {d} AS DATE) AS VARCHAR)"
    year = lambda e: f"coalesce(nullif({e}, ''), {hint})"
    full = "^(\\d{4})-(\\d{2})-(\\d{2})(?:[T ].*)?$"
    two = lambda e: f"lpad({e}, 2, '0')"
    return f"""coalesce(CASE
 WHEN regexp_matches({s}, '{full}') THEN {real(part(full, 1), part(full, 2), part(full, 3))}
 WHEN regexp_matches({s}, '^\\d{{4}}-\\d{{2}}$') THEN CASE WHEN right({s}, 2) BETWEEN '01' AND '12' THEN {s} END
 WHEN regexp_matches({s}, '^\\d{{4}}$') THEN {s}
 WHEN regexp_matches({s}, '{_DMY}') THEN {real(year(part(_DMY, 3)), month(part(_DMY, 2)), two(part(_DMY, 1)))}
 WHEN regexp_matches({s}, '{_MDY}') THEN {real(year(part(_MDY, 3)), month(part(_MDY, 1)), two(part(_MDY, 2)))}
 WHEN regexp_matches({s}, '{_MY}') THEN {part(_MY, 2)} || '-' || {month(part(_MY, 1))} END, {x})"""


def _number(x: str) -> str:
    s = _ws(f"regexp_replace(lower({x}), '{AROUND_NUMBER}', ' ', 'g')")
    shape = "^(\\d[\\d,]*(?:\\.\\d+)?)\\s*([a-z]+)?$"
    suffix = f"regexp_extract({s}, '{shape}', 2)"
    return f"CASE WHEN regexp_matches({s}, '{shape}') THEN CAST(replace(regexp_extract({s}, '{shape}', 1), ',', '') AS DOUBLE) * CASE WHEN {suffix} = '' THEN 1 ELSE {_case(suffix, MAGNITUDES)} END END"


def _number_text(n: str) -> str:
    return f"CASE WHEN abs({n} - round({n})) < 1e-6 THEN CAST(CAST(round({n}) AS HUGEINT) AS VARCHAR) ELSE CAST({n} AS VARCHAR) END"


def _scalar(table: str, key: str, raw: str, function) -> str:
    return f"WITH t AS (SELECT {key} AS id, {raw} AS raw FROM {table}) SELECT id, raw, {function('raw')} AS result FROM t"


def _single_year(x: str) -> str:
    found = f"list_distinct(regexp_extract_all(regexp_replace({x}, '(\\d+)', ' \\1 ', 'g'), ' ((?:19|20)\\d{{2}}) ', 1))"
    return f"CASE WHEN len({found}) = 1 THEN CAST({found}[1] AS INTEGER) END"


def _relax(x: str) -> str:
    s = f"regexp_replace({x}, '(?i)\\bsite:\\S+', ' ', 'g')"
    s = f"translate({s}, '\"“”', '   ')"
    s = f"regexp_replace({s}, '\\b(AND|OR|NOT)\\b', ' ', 'g')"
    return _ws(f"regexp_replace({s}, '(^|\\s)-\\w+', ' ', 'g')")


def _next_page(x: str) -> str:
    out = "NULL"
    for p in ("offset", "pg", "p", "page"):
        shape = f"^(.*?[?&]{p}=)(\\d+)((?:&|#).*)?$"
        out = f"CASE WHEN regexp_matches({x}, '{shape}') THEN regexp_extract({x}, '{shape}', 1) || (CAST(regexp_extract({x}, '{shape}', 2) AS BIGINT) + 1) || regexp_extract({x}, '{shape}', 3) ELSE {out} END"
    return out


_HREF = "(?is)\\bhref\\s*=\\s*[\"'']([^\"'']+)[\"'']"
_LINKS = "list_filter(regexp_extract_all(html, '(?is)<{0}\\b[^>]*>'), lambda t: regexp_matches(t, '(?is)\\brel\\s*=\\s*[\"''][^\"'']*{1}') AND regexp_matches(t, '" + _HREF + "'))"
_NEXT_HREF = "coalesce(" + ", ".join(f"nullif(regexp_extract({t}, '{_HREF}', 1), '')" for t in (_LINKS.format("link", "\\bnext\\b") + "[1]", _LINKS.format("a", "next") + "[1]", "regexp_extract(html, '(?is)<a\\b[^>]*>\\s*(?:next|next »|next →|›|»)\\s*</a')")) + ")"
_BASE = "regexp_extract(url, '^([^?#]*)', 1)"
_ORIGIN = "regexp_extract(url, '^([a-zA-Z][a-zA-Z0-9+.\\-]*://[^/?#]*)', 1)"
_ABSOLUTE = f"""CASE WHEN regexp_matches(href, '^[a-zA-Z][a-zA-Z0-9+.\\-]*:') THEN href WHEN starts_with(href, '//') THEN regexp_extract(url, '^([a-zA-Z][a-zA-Z0-9+.\\-]*:)', 1) || href
 WHEN starts_with(href, '/') THEN {_ORIGIN} || href WHEN starts_with(href, '?') THEN {_BASE} || href WHEN starts_with(href, '#') THEN regexp_extract(url, '^([^#]*)', 1) || href
 ELSE regexp_replace(CASE WHEN {_BASE} = {_ORIGIN} THEN {_BASE} || '/' ELSE {_BASE} END, '[^/]*$', '') || regexp_replace(href, '^(\\./)+', '') END"""

_AUTH = "^[a-zA-Z][a-zA-Z0-9+.\\-]*://([^/?#]*)"


def _reason(x: str) -> str:
    auth = f"regexp_extract({x}, '{_AUTH}', 1)"
    scheme = f"lower(regexp_extract({x}, '^([a-zA-Z][a-zA-Z0-9+.\\-]*):', 1))"
    host = f"lower(regexp_replace(regexp_replace(regexp_replace({auth}, '^.*@', ''), ':\\d*$', ''), '\\.$', ''))"
    deny = " OR ".join(f"{host} = '{d}' OR ends_with({host}, '.{d}')" for d in DENY)
    return f"""CASE WHEN {auth} = '' OR {scheme} NOT IN ('http', 'https') THEN 'not a fetchable http(s) URL'
 WHEN {deny} THEN 'domain is on the deny list (login-walled / ToS-sensitive)'
 WHEN {host} = '' THEN 'unsafe destination: only absolute HTTP(S) URLs are allowed'
 WHEN contains({auth}, '@') THEN 'unsafe destination: URLs containing credentials are not allowed'
 WHEN regexp_extract({auth}, ':(\\d+)$', 1) = '0' THEN 'unsafe destination: port zero is not a valid crawl destination' ELSE '' END"""


def _clean(x: str) -> str:
    s = x
    for tag in NO_CONTENT:
        s = f"regexp_replace({s}, '(?is)<{tag}\\b[^>]*>.*?</{tag}\\s*>', chr(10), 'g')"
    s = f"regexp_replace(regexp_replace({s}, '(?s)<!--.*?-->', chr(10), 'g'), '<[^>]+>', chr(10), 'g')"
    for a, b in (("&nbsp;", "chr(160)"), ("&lt;", "'<'"), ("&gt;", "'>'"), ("&quot;", "chr(34)"), ("&#39;", "chr(39)"), ("&amp;", "'&'")):
        s = f"replace({s}, '{a}', {b})"
    return s


_BLANKS = "'^[\\s\\x{00A0}]+|[\\s\\x{00A0}]+$'"
CLEAN_HTML = f"""WITH l AS (SELECT page_id, list_filter(list_transform(regexp_split_to_array({_clean('html')}, '[\\n\\r]+'), lambda x: regexp_replace(x, {_BLANKS}, '', 'g')), lambda x: x <> '') AS ls FROM pages),
c AS (SELECT page_id, coalesce(array_to_string(list_filter(ls, lambda x, i: i = 1 OR x <> ls[i - 1]), chr(10)), '') AS clean FROM l)
SELECT page_id, clean, length(clean) < 200 AS needs_render FROM c"""

_ORDERS = "(SELECT DISTINCT o_custkey AS entity, year(o_orderdate) AS occasion FROM orders)"
_EVENTS = "(SELECT DISTINCT user_id AS entity, CAST(ts AS DATE) AS occasion FROM events)"


def _chao(s: str, q1: str, q2: str, t: str) -> str:
    d = lambda x: f"CAST({x} AS DOUBLE)"
    return f"CASE WHEN {t} < 2 OR {s} = 0 THEN {d(s)} ELSE greatest({d(s)}, {d(s)} + ({d(t)} - 1) / {d(t)} * {d(q1)} * ({d(q1)} - 1) / (2 * ({d(q2)} + 1))) END"


def _estimate(i: str) -> str:
    return f"""WITH i AS {i}, k AS (SELECT entity, count(*) AS k FROM i GROUP BY entity),
f AS (SELECT count(*) AS s_obs, count(*) FILTER (k = 1) AS q1, count(*) FILTER (k = 2) AS q2, (SELECT count(DISTINCT occasion) FROM i) AS t FROM k)
SELECT *, {_chao('s_obs', 'q1', 'q2', 't')} AS s_hat FROM f"""


_BOOT = f"""i AS {_ORDERS}, pool AS (SELECT list(DISTINCT occasion ORDER BY occasion) AS pool FROM i),
draws AS (SELECT rep, pool, unnest(generate_series(1, len(pool))) AS n FROM range(500) r(rep), pool),
drawn AS (SELECT DISTINCT rep, len(pool) AS t, pool[1 + CAST('0x' || substr(md5('42:' || rep || ':' || n), 1, 8) AS BIGINT) % len(pool)] AS occasion FROM draws),
k AS (SELECT rep, t, entity, count(*) AS k FROM drawn JOIN i USING (occasion) GROUP BY ALL),
b AS (SELECT rep, t, count(*) AS s, count(*) FILTER (k = 1) AS q1, count(*) FILTER (k = 2) AS q2 FROM k GROUP BY ALL),
v AS (SELECT list_sort(list({_chao('s', 'q1', 'q2', 't')})) AS v FROM b),
ci AS (SELECT v[1 + greatest(0, CAST(floor(0.05 * len(v)) AS INTEGER) - 1)] AS ci_lo, v[1 + least(len(v) - 1, CAST(floor(0.95 * len(v)) AS INTEGER))] AS ci_hi FROM v)"""


def _trajectory(i: str) -> str:
    return f"""i AS {i}, o AS (SELECT occasion, row_number() OVER (ORDER BY occasion) AS t FROM (SELECT DISTINCT occasion FROM i)),
r AS (SELECT t, row_number() OVER (PARTITION BY entity ORDER BY t) AS r FROM i JOIN o USING (occasion)),
n AS (SELECT t, occasion, count(*) FILTER (r = 1) AS n1, count(*) FILTER (r = 2) AS n2, count(*) FILTER (r = 3) AS n3 FROM o LEFT JOIN r USING (t) GROUP BY ALL),
c AS (SELECT t, occasion, n1 AS new_entities, CAST(sum(n1) OVER w AS BIGINT) AS s_obs, CAST(sum(n1 - n2) OVER w AS BIGINT) AS q1, CAST(sum(n2 - n3) OVER w AS BIGINT) AS q2 FROM n WINDOW w AS (ORDER BY t)),
tr AS (SELECT *, {_chao('s_obs', 'q1', 'q2', 't')} AS s_hat FROM c),
y AS (SELECT *, CASE WHEN count(*) OVER (ORDER BY t) < 2 THEN 1 ELSE avg(new_entities) OVER (ORDER BY t ROWS 3 PRECEDING) / greatest(1, avg(new_entities) OVER (ORDER BY t)) END AS marginal_yield FROM tr)"""


#: After each occasion, the bootstrap over the occasions so far.
_STEP_BOUNDS = f"""sd AS (SELECT t, rep, unnest(generate_series(1, t)) AS n FROM o, range(500) r(rep)),
sdrawn AS (SELECT DISTINCT t, rep, 1 + CAST('0x' || substr(md5('42:' || rep || ':' || n), 1, 8) AS BIGINT) % t AS ot FROM sd),
sk AS (SELECT d.t, rep, entity, count(*) AS k FROM sdrawn d JOIN o ON o.t = d.ot JOIN i USING (occasion) GROUP BY ALL),
sb AS (SELECT t, rep, count(*) AS s, count(*) FILTER (k = 1) AS q1, count(*) FILTER (k = 2) AS q2 FROM sk GROUP BY ALL),
sv AS (SELECT t, list_sort(list({_chao('s', 'q1', 'q2', 't')})) AS v FROM sb GROUP BY t),
bounds AS (SELECT t, v[1 + least(len(v) - 1, CAST(floor(0.95 * len(v)) AS INTEGER))] AS ci_hi FROM sv)"""

CLAIMS = """claims AS (SELECT l_linestatus AS run, CAST(l_partkey AS VARCHAR) AS entity, 'discount' AS field, (CAST(l_orderkey AS BIGINT) * 1000 + l_linenumber) * 1000 + row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey, l_suppkey, l_discount, l_quantity) AS seq, CAST(l_discount AS VARCHAR) AS value, 's' || l_suppkey AS url,
 CAST(s_nationkey AS VARCHAR) AS domain, l_quantity / 50 AS support FROM lineitem JOIN supplier ON l_suppkey = s_suppkey)"""
MERGE = f"""{CLAIMS}, m1 AS (SELECT *, value = first_value(value) OVER (PARTITION BY run, entity ORDER BY seq) AS agrees, row_number() OVER (PARTITION BY run, entity ORDER BY seq) AS rn FROM claims),
m2 AS (SELECT *, lag(url) OVER (PARTITION BY run, entity, agrees ORDER BY seq) AS before FROM m1),
e AS (SELECT run, entity, max(seq) AS eseq, arg_max(value, seq) AS value, arg_max(url, seq) AS url, arg_max(coalesce(before, '-'), seq) AS b FROM m2 WHERE agrees AND (rn = 1 OR url <> before) GROUP BY run, entity),
x AS (SELECT m2.run, m2.entity, list(m2.url || '=' || m2.value ORDER BY m2.seq) AS xs FROM m2 JOIN e USING (run, entity) WHERE NOT agrees AND m2.seq > eseq AND m2.url <> e.url GROUP BY m2.run, m2.entity),
merged AS (SELECT run, entity, value, url, nullif(b, '-') AS corroborated_by, coalesce(len(xs), 0) AS n_conflicts, coalesce(array_to_string(xs, ';'), '') AS conflicts FROM e LEFT JOIN x USING (run, entity))"""

_LOGIT = "ln(least(greatest(trust, 0.01), 0.99) / (1 - least(greatest(trust, 0.01), 0.99)))"


def _kbt() -> str:
    out = f"""{CLAIMS}, ranked AS (SELECT *, {_name('value')} AS v, row_number() OVER (PARTITION BY run, entity, url ORDER BY coalesce(support, 0) DESC, seq) = 1 AS votes FROM claims),
pairs AS (SELECT run, entity, v, domain, count(*) AS n FROM ranked WHERE votes GROUP BY ALL), nv AS (SELECT run, entity, count(DISTINCT v) AS n_values FROM pairs GROUP BY run, entity),
t0 AS (SELECT DISTINCT run, entity, domain, 0.8 AS trust FROM pairs)"""
    for k in range(1, 11):
        out += f""",
s{k} AS (SELECT run, entity, v, sum(n * {_LOGIT}) AS s FROM pairs JOIN t{k - 1} USING (run, entity, domain) GROUP BY ALL),
e{k} AS (SELECT run, entity, v, exp(s - max(s) OVER (PARTITION BY run, entity)) AS e FROM s{k}), p{k} AS MATERIALIZED (SELECT run, entity, v, e / sum(e) OVER (PARTITION BY run, entity) AS p FROM e{k}),
t{k} AS MATERIALIZED (SELECT run, entity, domain, sum(n * p) / sum(n) AS trust FROM pairs JOIN p{k} USING (run, entity, v) GROUP BY ALL)"""
    return out + """,
probs AS (SELECT run, entity, v, CASE WHEN n_values = 1 THEN 1 ELSE p END AS prob FROM p10 JOIN nv USING (run, entity)),
scored AS (SELECT r.*, CASE WHEN votes THEN round(prob, 4) ELSE 0 END AS prob FROM ranked r LEFT JOIN probs USING (run, entity, v)),
won AS (SELECT run, entity, value, url, prob FROM (SELECT *, row_number() OVER (PARTITION BY run, entity ORDER BY prob DESC, seq) AS w FROM scored) WHERE w = 1)"""


_PPI = """f AS (SELECT doc_id AS id, coalesce(CASE WHEN doc_id % 17 <> 0 THEN n_chars % 101 / 100 END, 0.5) AS f FROM documents)"""
_VISITS = """visits AS (SELECT strftime(ts, '%Y-%m-%d') AS run, 'capture-' || event_id % 12 AS capture, 'https://u' || user_id || '.example.com' AS url,
 CASE WHEN event_type = 'error' THEN 'failed' WHEN value < 30 THEN 'skipped' ELSE 'ok' END AS status, event_id % 4 AS records_found, event_id AS seq FROM events),
keyed AS (SELECT *, left(run || ':' || capture || ':' || url, 220) AS id FROM visits),
ledger AS (SELECT id, arg_min(run, seq) AS run, arg_min(url, seq) AS url, arg_min(status, seq) AS status, arg_max(status, seq) AS status_final, arg_min(records_found, seq) AS records_found FROM keyed GROUP BY id)"""
_COMBOS = """combos AS (SELECT row_number() OVER (ORDER BY n_nationkey, ei) AS n, n_name AS query, engine, 'general' AS source_type
 FROM nation, (VALUES (0, 'ddg'), (1, 'brave'), (2, 'searxng')) e(ei, engine))"""
_GOLD = f"""base AS (SELECT {_name('c_name')} AS entity_key, c_mktsegment, CAST(c_nationkey AS VARCHAR) AS nation, c_custkey FROM customer),
pred AS (SELECT entity_key, CASE WHEN c_custkey % 7 = 0 THEN 'other' ELSE c_mktsegment END AS c_mktsegment, nation FROM base WHERE c_custkey % 3 <> 0),
gold AS (SELECT entity_key, c_mktsegment, CASE WHEN c_custkey % 5 <> 0 THEN nation END AS nation FROM base WHERE c_custkey % 4 <> 0)"""
_RESULTS = "r AS (SELECT n_name AS task_id, 'v' || n_nationkey % 3 AS version, n_nationkey / 30 AS item_f1, n_nationkey / 60 AS row_f1, n_nationkey / 25 AS coverage_est, n_nationkey % 9 / 9 AS item_recall, n_nationkey % 6 * 10 AS n_gold FROM nation), g AS (SELECT *, CASE WHEN n_gold > 0 THEN round(item_recall * n_gold) / n_gold END AS coverage_true FROM r)"


def _f1(name: str) -> str:
    return f"p AS {name}_precision, r AS {name}_recall, 2 * p * r / greatest(p + r, 1e-9) AS {name}_f1, n_pred, n_gold FROM (SELECT tp / greatest(n_pred, 1) AS p, tp / greatest(n_gold, 1) AS r, n_pred, n_gold FROM c)"


_NUM = "(\\d[\\d,]*(?:\\.\\d+)?)\\s*(?:(k|thousand|lakhs?|mn|m|million|crores?|cr|bn|b|billion)\\b)?"


def _numbers(x: str) -> str:
    return f"list_transform(list_zip(regexp_extract_all({x}, '{_NUM}', 1), regexp_extract_all({x}, '{_NUM}', 2)), lambda p: CAST(replace(p[1], ',', '') AS DOUBLE) * coalesce({_case('p[2]', TEXT_MAGNITUDES)}, 1))"


VALUE_IN_QUOTE = f"""WITH t AS (SELECT {QUOTED_VALUE} AS value, {QUOTE} AS quote FROM lineitem), u AS (SELECT value, quote, lower({_ws('value')}) AS v, lower(regexp_replace(quote, '\\s+', ' ', 'g')) AS q FROM t),
w AS (SELECT *, {_numbers('v')} AS vn, {_numbers('q')} AS qn, regexp_extract_all(v, '[a-z0-9]+') AS vt, regexp_extract_all(q, '[a-z0-9]+') AS qt FROM u),
x AS (SELECT value, quote <> '' AND ((v <> '' AND regexp_matches(q, '(^|[^a-z0-9])' || regexp_escape(v) || '($|[^a-z0-9])')) OR (len(vt) > 0 AND list_has_all(qt, vt))
 OR (len(vn) = 1 AND len(list_filter(qn, lambda n: abs(n - vn[1]) <= 0.005 * greatest(abs(n), 1e-9))) > 0)) AS backed FROM w)
SELECT value, backed, count(*) AS n FROM x GROUP BY ALL"""

_ANSWER = """CASE event_id % 4 WHEN 0 THEN concat('{"type": "noul", "noul": 0.', event_id % 100, '}') WHEN 1 THEN '{"type": "choice", "choice": "b"}' WHEN 2 THEN '{"type": "noul", "noul": "x"}' ELSE 'broken' END"""
_KEY = f"""CASE WHEN p_partkey % 2 = 0 THEN replace({RAW_NAME}, ' ', '') ELSE {RAW_NAME} END"""
_YEARS = "list_sort(list_distinct(regexp_extract_all(key, '\\b((?:19|20)\\d{2})\\b', 1)))"
_RUN8 = "round({}, 9) AS {}"

ORACLES: dict[str, str] = {
    "norm_text": _scalar("part", "p_partkey", RAW_TEXT, lambda x: f"lower({_ws(x)})"),
    "normalize_name": _scalar("part", "p_partkey", RAW_NAME, _name),
    "compact_key": _scalar("part", "p_partkey", RAW_NAME, lambda x: _compact(_name(x))),
    "normalize_date": _scalar("orders", "o_orderkey", RAW_DATE, lambda x: _date(x, "'2025'")),
    "normalize_date_no_hint": _scalar("orders", "o_orderkey", RAW_DATE, lambda x: _date(x, "CAST(NULL AS VARCHAR)")),
    "normalize_number": _scalar("orders", "o_orderkey", RAW_NUMBER, _number),
    "single_year": _scalar("part", "p_partkey", RAW_TEXT, _single_year),
    "relax_query": _scalar("orders", "o_orderkey", RAW_QUERY, _relax),
    "url_domain": _scalar("pages", "page_id", "url", _domain),
    "canonical_domain": _scalar("pages", "page_id", "url", _canonical),
    "next_page_url": _scalar("pages", "page_id", "url", _next_page),
    "compliance_gate": _scalar("pages", "page_id", "concat(CASE page_id % 6 WHEN 0 THEN 'https://www.linkedin.com/in/' WHEN 1 THEN 'ftp://a.b/' WHEN 2 THEN 'http://u:p@host.org/' WHEN 3 THEN 'https://host.org:0/' WHEN 4 THEN 'https://notlinkedin.com/' ELSE '' END, url)", _reason),
    "norm_value": f"""SELECT p_partkey AS id, CASE p_partkey % 3 WHEN 0 THEN 'https://host.org/' || p_partkey WHEN 1 THEN p_partkey || CAST(100 + p_size AS VARCHAR) || '.5' ELSE lower({_ws("p_type || '   ' || p_brand")}) END AS result FROM part""",
    "normalize_value": f"WITH t AS (SELECT o_orderkey AS id, {RAW_DATE} AS d, {RAW_NUMBER} AS n FROM orders), u AS (SELECT *, {_number('n')} AS x FROM t) SELECT id, {_date('d', chr(39) + '2025' + chr(39))} AS as_date, coalesce({_number_text('x')}, n) AS as_number, n AS as_string FROM u",
    "same_domain": f"WITH t AS (SELECT page_id, {_canonical('url')} AS domain FROM pages) SELECT domain, count(*) AS pages, min(page_id) AS first_page, CAST(count(*) * (count(*) - 1) / 2 AS BIGINT) AS pairs FROM t WHERE domain IS NOT NULL GROUP BY domain",
    "chunk_documents": "WITH t AS (SELECT doc_id, text, unnest(CASE WHEN length(text) <= 8000 THEN [0] ELSE generate_series(0, length(text) - 1, 7800) END) AS s FROM documents) SELECT doc_id, CAST(s / 7800 AS INTEGER) AS pos, CAST(length(substr(text, s + 1, 8000)) AS INTEGER) AS chars, md5(substr(text, s + 1, 8000)) AS chunk_md5 FROM t",
    "clean_html": CLEAN_HTML,
    "consecutive_dedupe": "WITH t AS (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents) SELECT doc_id, CAST(len(ls) AS INTEGER) AS lines, md5(array_to_string(list_filter(ls, lambda x, i: i = 1 OR x <> ls[i - 1]), chr(10))) AS deduped_md5 FROM t",
    "page_cache": "SELECT sha256(url) AS key, url, CAST(length(html) AS INTEGER) AS chars FROM pages",
    "decode_bytes": "SELECT doc_id, md5(text) AS decoded_md5 FROM documents",
    "public_ip": "SELECT DISTINCT user_id, CASE user_id % 6 WHEN 0 THEN concat('10.0.0.', user_id % 250) WHEN 1 THEN concat('8.8.4.', user_id % 250) WHEN 2 THEN '::ffff:8.8.8.8' WHEN 3 THEN '2002:808:808::1' WHEN 4 THEN '2606:4700::1111' ELSE '169.254.169.254' END AS address, user_id % 6 IN (1, 4) AS public FROM events",
    "robots_gate": f"WITH p AS (SELECT page_id, url, {_canonical('url')} AS domain FROM pages), n AS (SELECT domain, count(*) AS n FROM p GROUP BY domain) SELECT page_id, n % 3 = 0 OR n % 2 = 1 OR NOT regexp_matches(url, '^[a-z]+://[^/]+/p') AS allowed FROM p JOIN n USING (domain)",
    "next_link": f"WITH t AS (SELECT page_id, url, {_NEXT_HREF} AS href FROM pages) SELECT page_id, CASE WHEN href IS NULL THEN {_next_page('url')} ELSE {_ABSOLUTE} END AS next_url FROM t",
    "content_type_filter": "SELECT * FROM (SELECT page_id, CASE page_id % 4 WHEN 0 THEN 'text/html; charset=utf-8' WHEN 1 THEN 'application/pdf' WHEN 2 THEN 'text/plain' ELSE 'image/png' END AS content_type FROM pages) WHERE content_type LIKE '%html%' OR content_type LIKE '%text%'",
    "quote_on_page": f"""WITH d AS (SELECT doc_id, lower({_ws("substr(text, 11, 60)")}) AS own, lower(regexp_replace(coalesce(text, ''), '\\s+', ' ', 'g')) AS page FROM documents), b AS (SELECT item_id, lower({_ws('text')}) AS q FROM benchmark)
SELECT doc_id, item_id, own <> '' AND contains(page, own) AS own_on_page FROM d LEFT JOIN b ON q <> '' AND contains(page, q)""",
    "value_in_quote": VALUE_IN_QUOTE,
    "fields_sourced": "SELECT l_partkey AS entity, ((200 * count(*) FILTER (l_quantity > 20) + count(*)) // (2 * count(*))) / 100 AS fields_sourced FROM lineitem GROUP BY l_partkey",
    "page_gate": "SELECT * FROM (SELECT doc_id, CASE WHEN doc_id % 13 = 0 THEN NULL ELSE doc_id % 100 / 100 END AS p FROM documents) WHERE coalesce(p, 1) >= 0.35",
    "filter_gate": "WITH t AS (SELECT doc_id, CASE WHEN doc_id % 10 = 0 THEN [] ELSE [doc_id % 7 / 7, CASE WHEN doc_id % 5 = 0 THEN 0.5 ELSE doc_id % 11 / 11 END] END AS p FROM documents) SELECT doc_id, len(list_filter(p, lambda x: x >= 0.2 AND x < 0.5)) > 0 AS filter_uncertain FROM t WHERE len(p) = 0 OR list_min(p) >= 0.2",
    "claim_plan": """WITH t AS (SELECT l_partkey, 'discount' AS field, CASE WHEN l_discount > 0 THEN l_discount END AS value, CASE WHEN l_tax > 0 THEN 'quote' END AS evidence FROM lineitem UNION ALL SELECT l_partkey, 'tax', CASE WHEN l_tax > 0.02 THEN l_tax END, CASE WHEN l_discount > 0.03 THEN 'quote' END FROM lineitem)
SELECT field, CASE WHEN value IS NOT NULL AND evidence IS NOT NULL THEN CASE WHEN l_partkey % 2 = 0 THEN 0.9 ELSE 0.5 END END AS support, count(*) AS n, count(value) AS with_value, count(evidence) AS with_evidence FROM t WHERE value IS NOT NULL OR evidence IS NOT NULL GROUP BY 1, 2""",
    "has_primary": "SELECT CAST(l_linenumber - 3 AS VARCHAR) AS pk, count(*) AS n FROM lineitem WHERE l_linenumber > 3 GROUP BY 1",
    "public_metadata": "SELECT event_id, 'type' AS key, CAST(1 AS INTEGER) AS n FROM events",
    "premise_hypothesis": f"""WITH t AS (SELECT doc_id, lang, {_ws('text')} AS q, CASE WHEN doc_id % 2 = 0 THEN {_ws('substr(text, 101)')} ELSE '' END AS c FROM documents)
SELECT doc_id, md5(left(CASE WHEN c <> '' THEN left(c, 300) || ' ... ' || q ELSE q END, 600)) AS premise_md5, 'The language of ' || lang || ' is ' || doc_id || '.' AS hypothesis FROM t""",
    "judge_answers": f"WITH t AS (SELECT event_id, {_ANSWER} AS a FROM events), j AS (SELECT event_id, CASE WHEN json_valid(a) THEN a END AS j FROM t) SELECT event_id, CASE WHEN json_extract_string(j, '$.type') = 'noul' THEN TRY_CAST(json_extract_string(j, '$.noul') AS DOUBLE) END AS p, CASE WHEN json_extract_string(j, '$.type') = 'choice' THEN json_extract_string(j, '$.choice') END AS choice FROM j",
    "format_error": "SELECT event_id, CASE event_id % 6 WHEN 0 THEN 'bad request ' || event_id WHEN 1 THEN 'too slow' WHEN 2 THEN 'no. (x)' WHEN 3 THEN 'An unexpected pipeline error occurred.' WHEN 4 THEN 'it''s ' || event_id ELSE 'plain ' || event_type END AS message FROM events",
    "trust_scores": "WITH t AS (SELECT DISTINCT l_discount, l_tax, least(greatest(l_discount * 10, 0.01), 0.99) AS p FROM lineitem) SELECT l_discount, l_tax, round(ln(p / (1 - p)), 9) AS logit, round(p, 9) AS back, round(exp(l_discount) / (exp(l_discount) + exp(l_tax) + exp(0.05)), 9) AS soft_first FROM t",
    "entity_keys": f"SELECT p_partkey, {_name(RAW_NAME)} AS entity_key FROM part",
    "match_existing_key": f"""WITH k AS (SELECT {_name(_KEY)} AS key, min(p_partkey) AS seq FROM part GROUP BY 1), c AS (SELECT *, {_compact('key')} AS compact, {_YEARS} AS ys FROM k),
j AS (SELECT a.key, b.key AS other, row_number() OVER (PARTITION BY a.key ORDER BY b.seq) AS r FROM c a JOIN c b ON a.compact = b.compact AND b.seq <= a.seq AND a.compact <> '' AND (len(a.ys) = 0 OR len(b.ys) = 0 OR a.ys = b.ys))
SELECT c.key, coalesce(other, c.key) AS canonical FROM c LEFT JOIN j ON c.key = j.key AND r = 1""",
    "group_by_entity": f"WITH t AS (SELECT p_partkey, {RAW_NAME} AS raw FROM part), k AS (SELECT *, {_name('raw')} AS entity_key FROM t) SELECT entity_key, count(*) AS n_rows, arg_min(raw, p_partkey) AS first_name, count(DISTINCT raw) AS n_spellings FROM k GROUP BY entity_key",
    "entity_components": """WITH RECURSIVE e AS (SELECT DISTINCT min(l_suppkey) OVER (PARTITION BY l_partkey) AS a, l_suppkey AS b FROM lineitem),
b AS (SELECT a AS u, b AS v FROM e UNION SELECT b, a FROM e), w(u, r) AS (SELECT u, u FROM b UNION SELECT b.v, w.r FROM w JOIN b USING (u)) SELECT u AS supplier, min(r) AS root FROM w GROUP BY u""",
    "dedupe_urls": f"SELECT {_domain('url')} AS url, arg_min(md5(html), page_id) AS title, min(page_id) AS rank FROM pages GROUP BY 1",
    "runs_with_counts": "SELECT c_custkey AS run, c_mktsegment, (SELECT count(*) FROM orders WHERE o_custkey = c_custkey) AS records FROM customer",
    "claims_filtered": f"WITH {CLAIMS} SELECT run, entity, seq, value, url FROM claims WHERE field = 'discount' AND domain = '7'",
    "captures_of_run": f"WITH {_VISITS} SELECT run, capture, min(seq) AS first_seq, count(*) AS visits FROM visits WHERE run = '2024-01-03' GROUP BY ALL",
    "records_of_run": f"WITH {MERGE}, f AS (SELECT run, entity, min(seq) AS found FROM claims GROUP BY ALL) SELECT run, entity, left(run || ':' || entity, 120) AS id, value AS discount, found FROM merged JOIN f USING (run, entity)",
    "typed_events": "SELECT event_id, event_type AS type, CAST(json_extract(props, '$.k') AS INTEGER) AS k FROM events",
    "fetch_schedule": f"WITH p AS (SELECT page_id, url, {_canonical('url')} AS domain FROM pages) SELECT page_id, domain, (row_number() OVER (PARTITION BY domain ORDER BY page_id, url) - 1) * CASE WHEN length(domain) % 2 = 0 THEN CAST(2.5 AS DOUBLE) ELSE 1 END AS start_s FROM p",
    "labels_of_claims": "SELECT l.doc_id AS id, quality AS correct, CASE WHEN d.doc_id % 17 <> 0 THEN n_chars % 101 / 100 END AS score FROM labels l JOIN documents d USING (doc_id)",
    "record_lookup": "SELECT o_orderkey, o_orderstatus FROM orders WHERE o_custkey = 7",
    "source_ledger": f"WITH {_VISITS} SELECT id, status, status_final, records_found FROM ledger",
    "run_stats": f"WITH {_VISITS} SELECT run, count(*) AS pages, count(*) FILTER (status = 'ok') AS pages_ok, count(*) FILTER (status = 'skipped') AS pages_skipped, count(*) FILTER (status = 'failed') AS pages_failed, count(DISTINCT url) AS urls, CAST(sum(records_found) AS BIGINT) AS records_found FROM ledger GROUP BY run",
    "label_upsert": "SELECT event_id % 500 AS claim_id, CAST(arg_max(value > 50, event_id) AS INTEGER) AS correct, 'u' || arg_max(user_id, event_id) AS labeler, min(strftime(ts, '%Y-%m-%d %H:%M:%S')) AS created_at FROM events GROUP BY 1",
    "upsert_records": f"WITH {MERGE} SELECT run, entity, value, url, corroborated_by, CAST(n_conflicts AS INTEGER) AS n_conflicts, conflicts FROM merged",
    "export_rows": f"WITH {MERGE} SELECT run, entity, value AS discount, url AS supplier, round((1 + CAST(value = '0.05' AS INTEGER)) / 2, 2) AS fields_sourced, url AS sources, CASE WHEN n_conflicts > 0 THEN 'yes' ELSE '' END AS has_conflict FROM merged",
    "has_conflict": f"WITH {MERGE} SELECT n_conflicts > 0 AS has_conflict, count(*) AS cells FROM merged GROUP BY 1",
    "chao2_estimate": _estimate(_ORDERS),
    "chao2_events": _estimate(_EVENTS),
    "bootstrap_ci": f"WITH {_BOOT} SELECT ci_lo, ci_hi FROM ci",
    "coverage_summary": f"WITH {_BOOT}, z AS ({_estimate(_ORDERS)}) SELECT s_obs, s_hat, ci_lo AS ci_lo_s, ci_hi AS ci_hi_s, least(1, s_obs / s_hat) AS coverage_est, least(1, s_obs / ci_hi) AS coverage_lo, least(1, s_obs / ci_lo) AS coverage_hi, t FROM z, ci",
    "coverage_trajectory": f"WITH {_trajectory(_ORDERS)} SELECT CAST(t AS INTEGER) AS t, CAST(occasion AS INTEGER) AS occasion, new_entities, s_obs, q1, q2, s_hat FROM tr",
    "marginal_yield": f"WITH {_trajectory(_EVENTS)} SELECT CAST(t AS INTEGER) AS t, new_entities, marginal_yield FROM y",
    "stop_capture": f"WITH {_trajectory(_ORDERS)}, {_STEP_BOUNDS}, z AS (SELECT y.*, CASE WHEN t < 2 OR s_obs < 2 THEN 1 ELSE least(1, s_obs / ci_hi) END AS coverage_lo FROM y JOIN bounds USING (t)) SELECT CAST(t AS INTEGER) AS t, coverage_lo, marginal_yield, t >= 2 AND s_obs >= 2 AND ((t >= 3 AND s_obs >= 5 AND coverage_lo >= 0.8) OR (marginal_yield < 0.02 AND t >= 4)) AS stop FROM z",
    "kbt_voters": f"WITH {_kbt()} SELECT run, entity, url, seq, value, support FROM ranked WHERE votes",
    "kbt_probs": f"WITH {_kbt()} SELECT run, entity, v, round(prob, 6) AS prob FROM probs",
    "kbt_winner": f"WITH {_kbt()} SELECT run, entity, value, url, prob FROM won",
    "conflicts_resolved": f"""WITH {MERGE}, {_kbt().replace(CLAIMS + ', ', '')}, n AS (SELECT run, entity, count(*) AS n FROM claims GROUP BY run, entity),
z AS (SELECT m.*, CAST(w.value AS DOUBLE) AS nv, w.url AS nu, w.prob, n_conflicts > 0 AND n >= 2 AND CAST(w.value AS DOUBLE) <> 0 AND CAST(w.value AS DOUBLE) <> CAST(m.value AS DOUBLE) AS resolved FROM merged m JOIN won w USING (run, entity) JOIN n USING (run, entity))
SELECT run, entity, CASE WHEN resolved THEN {_number_text('nv')} ELSE value END AS value, CASE WHEN resolved THEN nu ELSE url END AS url, CASE WHEN resolved THEN prob END AS kbt_prob, CASE WHEN resolved THEN 'Resolved from ' || (n_conflicts + 1) || ' conflicting sources' END AS conflict_note, resolved FROM z""",
    "ppi_accuracy": f"WITH {_PPI}, j AS (SELECT f, quality - f AS d FROM f LEFT JOIN (SELECT doc_id AS id, quality FROM labels) USING (id)), m AS (SELECT count(*) AS n_cells, count(d) AS n_labeled, avg(f) + avg(d) AS t, sqrt(var_samp(f) / count(*) + var_samp(d) / count(d)) AS se FROM j) SELECT round(greatest(0, least(1, t)), 9) AS theta_hat, round(greatest(0, least(1, t - 1.96 * se)), 9) AS ci_low, round(greatest(0, least(1, t + 1.96 * se)), 9) AS ci_high, round(se, 9) AS se, n_cells, n_labeled FROM m",
    "ppi_unlabeled": f"WITH {_PPI}, m AS (SELECT count(*) AS n_cells, CAST(0 AS BIGINT) AS n_labeled, avg(f) AS t, sqrt(var_samp(f) / count(*)) AS se FROM f) SELECT round(t, 9) AS theta_hat, round(greatest(0, t - 1.96 * se), 9) AS ci_low, round(least(1, t + 1.96 * se), 9) AS ci_high, round(se, 9) AS se, n_cells, n_labeled FROM m",
    "audit_sample": "WITH s AS (SELECT doc_id AS id, CASE WHEN doc_id % 17 <> 0 THEN n_chars % 101 / 100 END AS score FROM documents), u AS (SELECT *, coalesce(score BETWEEN 0.3 AND 0.7, false) AS uncertain, md5('42:' || id) AS key FROM s), r AS (SELECT *, row_number() OVER (PARTITION BY uncertain ORDER BY key, id) AS r FROM u), z AS (SELECT *, row_number() OVER (ORDER BY uncertain DESC, r) AS k FROM r WHERE NOT uncertain OR r <= 15) SELECT id, score, uncertain FROM z WHERE k <= 30",
    "conformal_threshold": "WITH t AS (SELECT round(l_quantity / 50, 2) AS score, CASE WHEN (l_orderkey * 7 + l_partkey) % 1000 < greatest(0, 300 - 6 * l_quantity) THEN 0 ELSE 1 END AS correct FROM lineitem), s AS (SELECT score, count(*) AS n, count(*) FILTER (correct = 0) AS w FROM t GROUP BY score), a AS (SELECT score, sum(n) OVER (ORDER BY score DESC) AS n, sum(w) OVER (ORDER BY score DESC) AS w FROM s) SELECT coalesce(max(score), 1) AS tau, count(*) AS n_qualifying FROM a WHERE w / n + sqrt(ln(1 / 0.1) / (2 * n)) <= 0.05",
    "capture_combos": f"WITH {_COMBOS} SELECT CAST(n AS INTEGER) AS n, query, engine, source_type FROM combos",
    "untried_combos": f"WITH {_COMBOS} SELECT CAST(n AS INTEGER) AS n, query, engine, source_type FROM combos WHERE n % 3 <> 1 ORDER BY n LIMIT 12",
    "replan_filter": "SELECT n_nationkey AS seq, n_name AS query FROM nation WHERE n_nationkey % 2 = 1 ORDER BY n_nationkey LIMIT 3",
    "replan_trigger": f"WITH {_VISITS}, c AS (SELECT run, capture, count(*) AS chunks, count(*) FILTER (status = 'skipped') AS gated, CAST(sum(records_found) AS BIGINT) AS new_entities FROM visits GROUP BY ALL) SELECT *, new_entities = 0 OR (chunks > 0 AND gated >= 0.9 * chunks) AS replan FROM c",
    "top_urls": f"WITH {_VISITS}, u AS (SELECT capture, url, min(seq) AS rank FROM visits GROUP BY ALL) SELECT capture, url, rank FROM (SELECT *, row_number() OVER (PARTITION BY capture ORDER BY rank, url) AS r FROM u) WHERE r <= 6",
    "relaxed_results": "WITH t AS (SELECT CAST(user_id % 60 AS VARCHAR) AS query, 'u' || user_id AS url, event_id AS rank FROM events), s AS (SELECT * FROM t WHERE rank % 97 < 2), n AS (SELECT query FROM s GROUP BY query HAVING count(*) >= 3), a AS (SELECT * FROM s UNION ALL SELECT query, url, rank + 1000000 FROM t WHERE query NOT IN (SELECT query FROM n)) SELECT query, url, min(rank) AS rank FROM a GROUP BY ALL",
    "item_f1": f"WITH {_GOLD}, c AS (SELECT (SELECT count(*) FROM (SELECT DISTINCT entity_key FROM pred INTERSECT SELECT entity_key FROM gold)) AS tp, (SELECT count(DISTINCT entity_key) FROM pred) AS n_pred, (SELECT count(DISTINCT entity_key) FROM gold) AS n_gold) SELECT {_f1('item')}",
    "row_f1": f"WITH {_GOLD}, j AS (SELECT p.entity_key AS a, g.entity_key AS b, (g.c_mktsegment IS NULL OR lower(p.c_mktsegment) = lower(g.c_mktsegment)) AND (g.nation IS NULL OR p.nation = g.nation) AS same FROM pred p FULL JOIN gold g USING (entity_key)), c AS (SELECT count(*) FILTER (a IS NOT NULL AND b IS NOT NULL AND same) AS tp, count(a) AS n_pred, count(b) AS n_gold FROM j) SELECT {_f1('row')}",
    "cce": f"WITH {_RESULTS} SELECT count(*) AS n_tasks, round(avg(item_f1), 9) AS mean_item_f1, round(avg(row_f1), 9) AS mean_row_f1, round(avg(abs(coverage_est - coverage_true)), 9) AS cce, count(coverage_true) AS n_cce_tasks FROM g",
    "calibration_points": f"WITH {_RESULTS} SELECT task_id, coverage_est, coverage_true FROM g",
    "ablation_pivot": f"WITH {_RESULTS}, l AS (SELECT version, 'item_f1' AS metric, item_f1 AS value FROM r UNION ALL SELECT version, 'row_f1', row_f1 FROM r UNION ALL SELECT version, 'coverage_est', coverage_est FROM r) SELECT metric, " + ", ".join(f"round(avg(value) FILTER (version = 'v{k}'), 9) AS v{k}" for k in range(3)) + " FROM l GROUP BY metric",
    "stream_windows": "SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL",
    "stream_coverage": _estimate(_ORDERS),
}
