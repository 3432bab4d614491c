"""Requests, ownership, codes, sessions, rates."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attest.functions.columns import WORD_END, WORD_START
from attest.functions.network import in_cidr
from attest.operators.access import (
    Bucket,
    code_outcomes,
    flow_state,
    latest_unseen,
    lookup_owned,
    match_route,
    owned,
    rate_limit,
    request_counts,
    route,
    session_state,
)
from attest.operators.lookup import lookup_range, match_route_table
from attest.queries.registry import Tables, query

QUAD_SHAPE = r"([0-9]{1,3}(?:\.[0-9]{1,3}){3})"
QUAD = rf"\b{QUAD_SHAPE}\b"
ASCII_QUAD = f"{WORD_START}{QUAD_SHAPE}{WORD_END}"
RANGES = ["10.0.0.0/8", "192.168.0.0/16", "172.16.0.0/12", "203.0.113.0/24", "100.64.0.0/10", "128.0.0.0/2"]
QUAD_NUMBER = """CAST(split_part(address, '.', 1) AS BIGINT) * 16777216 + CAST(split_part(address, '.', 2) AS BIGINT) * 65536
   + CAST(split_part(address, '.', 3) AS BIGINT) * 256 + CAST(split_part(address, '.', 4) AS BIGINT)"""


@query("in_cidr", rf"""
WITH a AS (SELECT doc_id, unnest(regexp_extract_all(text, '{QUAD}', 1)) AS address FROM documents
           UNION ALL SELECT event_id, concat(user_id, '.', CAST(value * 10 AS INT), '.', regexp_extract(props, '[0-9]+'), '.1') FROM events),
n AS (SELECT *, regexp_matches(address, '\A(?:(?:[0-9]|[1-9][0-9]|1[0-9][0-9]|2[0-4][0-9]|25[0-5])(?:\.|\z)){{4}}\z') AS valid, {QUAD_NUMBER} AS num FROM a)
SELECT doc_id AS id, address, valid AND ((num BETWEEN 167772160 AND 184549375) OR (num BETWEEN 3232235520 AND 3232301055)
   OR (num BETWEEN 2886729728 AND 2887778303) OR (num BETWEEN 3405803776 AND 3405804031) OR (num BETWEEN 1681915904 AND 1686110207)
   OR (num BETWEEN 2147483648 AND 3221225471)) AS allowed FROM n
""")
def addresses(t: Tables) -> DataFrame:
    found = t.documents.select(
        F.col("doc_id").alias("id"), F.explode(F.regexp_extract_all("text", F.lit(ASCII_QUAD), F.lit(1))).alias("address")
    )
    built = F.concat_ws(".", F.col("user_id").cast("string"), F.bround(F.col("value") * 10).cast("int").cast("string"),
                        F.regexp_extract("props", "[0-9]+", 0), F.lit("1"))
    rows = found.unionByName(t.events.select(F.col("event_id").alias("id"), built.alias("address")))
    return rows.withColumn("allowed", in_cidr("address", RANGES))


ADDRESS_ROWS = rf"""
a AS (SELECT doc_id AS id, unnest(regexp_extract_all(text, '{QUAD}', 1)) AS address, 8 + length(text) % 25 AS bits FROM documents
           UNION ALL SELECT event_id, concat(user_id, '.', CAST(value * 10 AS INT), '.', regexp_extract(props, '[0-9]+'), '.1'), 8 + length(props) % 25 FROM events),
n AS (SELECT *, regexp_matches(address, '\A(?:(?:[0-9]|[1-9][0-9]|1[0-9][0-9]|2[0-4][0-9]|25[0-5])(?:\.|\z)){{{{4}}}}\z') AS valid, {QUAD_NUMBER} AS num FROM a)
""".replace("{{4}}", "{4}")


@query("lookup_range", f"""
WITH {ADDRESS_ROWS},
r AS (SELECT concat('r', bits) AS name, concat(address, '/', bits) AS range, bits, num FROM n WHERE valid AND bits < 32),
v AS (SELECT DISTINCT num AS value FROM n WHERE valid),
m AS (SELECT value, r.name, r.range, row_number() OVER (PARTITION BY value ORDER BY r.bits DESC, r.name, r.range) AS k
      FROM v JOIN r ON v.value >> (32 - r.bits) = r.num >> (32 - r.bits))
SELECT id, address, m.range, m.name FROM n LEFT JOIN m ON valid AND num = value AND k = 1
""")
def ranges_by_table(t: Tables) -> DataFrame:
    """Every address makes a range as well, as wide as its row is long; they nest and repeat."""
    bits = lambda c: (8 + F.char_length(c) % 25).alias("bits")
    found = t.documents.select(F.col("doc_id").alias("id"), F.explode(F.regexp_extract_all("text", F.lit(ASCII_QUAD), F.lit(1))).alias("address"), bits("text"))
    built = F.concat_ws(".", F.col("user_id").cast("string"), F.bround(F.col("value") * 10).cast("int").cast("string"),
                        F.regexp_extract("props", "[0-9]+", 0), F.lit("1"))
    rows = found.unionByName(t.events.select(F.col("event_id").alias("id"), built.alias("address"), bits("props")))
    ranges = rows.where("bits < 32").select(F.concat(F.lit("r"), F.col("bits").cast("string")).alias("name"), F.concat("address", F.lit("/"), F.col("bits").cast("string")).alias("cidr"))
    return lookup_range(rows.drop("bits"), "address", ranges)


@query("match_route_table", r"""
WITH p AS (SELECT page_id, regexp_extract(url, '^[a-z]+://[^/]+([^?#]*)', 1) AS path, length(html) % 7 AS n FROM pages),
r AS (SELECT starts_with(path, '/de/') AS exact, CASE WHEN starts_with(path, '/de/') THEN path ELSE left(path, 2 + length(path) % 4) END AS route, concat('b', n) AS backend FROM p),
e AS (SELECT route, min(backend) AS backend FROM r WHERE exact GROUP BY route),
l AS (SELECT path, arg_max(backend, length(route)) AS backend FROM (SELECT DISTINCT path FROM p)
      JOIN (SELECT route, min(backend) AS backend FROM r WHERE NOT exact GROUP BY route) ON starts_with(path, route) GROUP BY path)
SELECT page_id, p.path, coalesce(e.backend, l.backend) AS backend FROM p LEFT JOIN e ON e.route = p.path LEFT JOIN l ON l.path = p.path
""")
def backends_by_table(t: Tables) -> DataFrame:
    paths = t.pages.select("page_id", F.regexp_extract("url", r"\A[a-z]+://[^/]+([^?#]*)", 1).alias("path"), (F.char_length("html") % 7).alias("n"))
    exact = F.startswith(F.col("path"), F.lit("/de/"))
    route = F.when(exact, F.col("path")).otherwise(F.left("path", 2 + F.char_length("path") % 4))
    routes = paths.select(exact.alias("exact"), route.alias("route"), F.concat(F.lit("b"), F.col("n").cast("string")).alias("backend"))
    return match_route_table(paths.drop("n"), "path", routes)


@query("route", r"""
WITH p AS (SELECT page_id, regexp_extract(url, '^[a-z]+://([^/]+)', 1) AS host,
   concat(CASE WHEN starts_with(url, 'https') THEN '/api' ELSE '/apis' END, regexp_extract(url, '^[a-z]+://[^/]+([^?#]*)', 1)) AS path,
   CASE WHEN regexp_matches(url, '^https?://m\.') THEN '10.128.0.1' ELSE '10.127.255.254' END AS source FROM pages),
h AS (SELECT *, CASE WHEN ends_with(host, '.com') THEN concat(upper('Site.example.com'), CASE WHEN starts_with(host, 'www') THEN ':443' ELSE '' END) ELSE host END AS asked FROM p)
SELECT page_id, CASE WHEN source = '10.128.0.1' THEN 403 WHEN lower(asked) NOT IN ('site.example.com', 'site.example.com:443') THEN 403
     WHEN NOT starts_with(path, '/api/') THEN 404 ELSE 200 END::BIGINT AS status,
  CASE WHEN source <> '10.128.0.1' AND lower(asked) IN ('site.example.com', 'site.example.com:443') AND starts_with(path, '/api/') THEN substr(path, 5) END AS forward_path
FROM h
""")
def routed(t: Tables) -> DataFrame:
    host = F.regexp_extract("url", r"\A[a-z]+://([^/]+)", 1)
    asked = F.when(host.endswith(".com"),
                   F.concat(F.lit("SITE.EXAMPLE.COM"), F.when(host.startswith("www"), ":443").otherwise(""))).otherwise(host)
    path = F.concat(F.when(F.startswith(F.col("url"), F.lit("https")), "/api").otherwise("/apis"),
                    F.regexp_extract("url", r"\A[a-z]+://[^/]+([^?#]*)", 1))
    source = F.when(F.col("url").rlike(r"\Ahttps?://m\."), "10.128.0.1").otherwise("10.127.255.254")
    rows = t.pages.select("page_id", asked.alias("host"), path.alias("path"), source.alias("source"))
    return route(rows, "source", "host", "path", ["10.0.0.0/9"], "site.example.com").select(
        "page_id", "status", "forward_path"
    )


@query("match_route", r"""
SELECT page_id, CASE WHEN path = '/en/25' THEN 'exact' WHEN starts_with(path, '/en/9') THEN 'newest' WHEN starts_with(path, '/en/') THEN 'english'
   WHEN starts_with(path, '/') THEN 'default' END AS backend
FROM (SELECT page_id, regexp_extract(url, '^[a-z]+://[^/]+([^?#]*)', 1) AS path FROM pages)
""")
def backends(t: Tables) -> DataFrame:
    path = F.regexp_extract("url", r"\A[a-z]+://[^/]+([^?#]*)", 1)
    routes = {"/": "default", "/en/": "english", "/en/9": "newest"}
    return t.pages.select("page_id", match_route(path, {"/en/25": "exact"}, routes).alias("backend"))


@query("owned", "SELECT o_orderkey, o_orderstatus FROM orders WHERE o_custkey = 42")
def owned_orders(t: Tables) -> DataFrame:
    return owned(t.orders, "o_custkey", 42).select("o_orderkey", "o_orderstatus")


@query("lookup_owned", """
WITH q AS (SELECT l_orderkey AS o_orderkey, l_partkey AS o_custkey, l_linenumber FROM lineitem
           UNION ALL SELECT o_orderkey, o_custkey, 0 FROM orders)
SELECT q.o_orderkey, q.o_custkey, o.o_orderstatus, o.o_orderkey IS NOT NULL AS found, count(*) AS n_rows
FROM q LEFT JOIN orders o ON o.o_orderkey = q.o_orderkey AND o.o_custkey = q.o_custkey GROUP BY ALL
""")
def ownership(t: Tables) -> DataFrame:
    guesses = t.lineitem.select(F.col("l_orderkey").alias("o_orderkey"), F.col("l_partkey").alias("o_custkey"), "l_linenumber")
    own = t.orders.select("o_orderkey", "o_custkey", F.lit(0).alias("l_linenumber"))
    answers = lookup_owned(t.orders, guesses.unionByName(own), "o_orderkey", "o_custkey", ["o_orderstatus"])
    return answers.groupBy("o_orderkey", "o_custkey", "o_orderstatus", "found").agg(F.count(F.lit(1)).alias("n_rows"))


@query("latest_unseen", """
WITH m AS (SELECT concat(conv_id, '-', turn) AS id, conv_id * 1000 + turn AS pos, unnest([concat('c', conv_id), role]) AS recipient, length(text) AS n FROM conversations
           WHERE NOT (turn = 0 AND role = 'user'))
SELECT recipient, arg_min(id, pos) AS id, arg_min(n, pos) AS n FROM m GROUP BY recipient
""")
def unseen(t: Tables) -> DataFrame:
    number = F.concat_ws("-", F.col("conv_id").cast("string"), F.col("turn").cast("string"))
    messages = t.conversations.select(
        number.alias("id"),
        (F.col("conv_id") * 1000 + F.col("turn")).alias("pos"),
        F.array(F.concat(F.lit("c"), F.col("conv_id").cast("string")), "role").alias("recipients"),
        F.char_length("text").cast("bigint").alias("n"),
    )
    seen = t.conversations.where((F.col("turn") == 0) & (F.col("role") == "user")).select(number.alias("id"))
    return latest_unseen(messages, seen, "id", "recipients", "pos", ["n"])


FLOWS = """
WITH e AS (SELECT event_id, user_id, ts, event_type, CAST(value AS INT) // 10 AS code FROM events WHERE event_type IN ('signup', 'click', 'view')),
i AS (SELECT *, sum(CASE WHEN event_type = 'signup' THEN 1 ELSE 0 END) OVER w AS gen FROM e
      WINDOW w AS (PARTITION BY user_id ORDER BY ts, CASE WHEN event_type = 'signup' THEN 0 ELSE 1 END, event_id)),
g AS (SELECT *, first_value(ts) OVER w AS issued_at, first_value(code) OVER w AS issued_code,
        sum(CASE WHEN event_type = 'signup' THEN 0 ELSE 1 END) OVER w AS attempt
      FROM i WINDOW w AS (PARTITION BY user_id, gen ORDER BY ts, CASE WHEN event_type = 'signup' THEN 0 ELSE 1 END, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
"""
LIFETIME = 2 * 86_400


def _flow_events(t: Tables) -> tuple[DataFrame, DataFrame]:
    rows = t.events.select("event_id", "user_id", "ts", "event_type",
                           F.floor(F.bround("value") / 10).cast("bigint").alias("code"))
    return rows.where(F.col("event_type") == "signup"), rows.where(F.col("event_type").isin("click", "view"))


@query("code_outcomes", FLOWS + """
SELECT event_id, CASE WHEN gen > 0 THEN CAST(attempt AS BIGINT) END AS attempt,
  CASE WHEN gen = 0 THEN 'no_code' WHEN ts > issued_at + INTERVAL 2 DAY THEN 'expired' WHEN attempt > 2 THEN 'too_many'
       WHEN code <> issued_code THEN 'wrong_code' ELSE 'accepted' END AS outcome FROM g WHERE event_type <> 'signup'
""")
def submissions(t: Tables) -> DataFrame:
    result = code_outcomes(*_flow_events(t), "user_id", "ts", "event_id", "code",
                           lifetime_seconds=LIFETIME, max_submissions=2)
    return result.select("event_id", "attempt", "outcome")


@query("flow_state", FLOWS + """
SELECT event_id, CASE WHEN gen = 0 THEN 'none' WHEN ts > issued_at + INTERVAL 2 DAY THEN 'expired' WHEN attempt > 2 THEN 'exhausted' ELSE 'open' END AS state
FROM g WHERE event_type <> 'signup'
""")
def flows(t: Tables) -> DataFrame:
    result = flow_state(*_flow_events(t), "user_id", "ts", "event_id", lifetime_seconds=LIFETIME, max_submissions=2)
    return result.select("event_id", "state")


@query("session_state", """
WITH m AS (SELECT event_id, user_id, ts,
   last_value(CASE WHEN event_type IN ('signup', 'error') THEN event_type END IGNORE NULLS) OVER w AS kind,
   last_value(CASE WHEN event_type IN ('signup', 'error') THEN ts END IGNORE NULLS) OVER w AS marked_at
 FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
SELECT event_id, coalesce(kind = 'signup' AND ts < marked_at + INTERVAL 24 HOUR, false) AS active FROM m
""")
def sessions(t: Tables) -> DataFrame:
    rows = t.events.select("event_id", "user_id", "ts", "event_type")
    kind = F.col("event_type")
    result = session_state(rows, "user_id", "ts", "event_id", kind == "signup", kind == "error", lifetime_seconds=86_400)
    return result.select("event_id", "active")


DAY_MS = 86_400_000
EVERYTHING = Bucket(limit=2, period_ms=DAY_MS, burst=2)
CLICKS = Bucket(limit=1, period_ms=DAY_MS, burst=1)

RATE_SQL = """
WITH RECURSIVE r AS (SELECT event_id, user_id, epoch_ms(ts) AS tick, event_type = 'click' AS mut,
    row_number() OVER (PARTITION BY user_id ORDER BY epoch_ms(ts), event_id) AS rn FROM events),
s AS (
  SELECT user_id, rn, event_id, CAST(0 AS BIGINT) AS e, tick AS l, CAST(0 AS BIGINT) AS me, CASE WHEN mut THEN tick END AS ml, true AS ok FROM r WHERE rn = 1
  UNION ALL
  SELECT user_id, rn, event_id, CASE WHEN ok THEN ne ELSE e END, CASE WHEN ok THEN tick ELSE l END,
         CASE WHEN ok AND mut THEN nme ELSE me END, CASE WHEN ok AND mut THEN tick ELSE ml END, ok
  FROM (SELECT *, ne <= 2000 AND (NOT mut OR nme <= 1000) AS ok FROM (
    SELECT r.user_id, r.rn, r.event_id, r.tick, r.mut, s.e, s.l, s.me, s.ml,
      greatest(0, s.e - (2000 * (r.tick - s.l)) // 86400000 + 1000) AS ne,
      CASE WHEN s.ml IS NULL THEN 0 ELSE greatest(0, s.me - (1000 * (r.tick - s.ml)) // 86400000 + 1000) END AS nme
    FROM s JOIN r ON r.user_id = s.user_id AND r.rn = s.rn + 1))
)
SELECT event_id, ok AS allowed FROM s
"""


@query("rate_limit", RATE_SQL)
def rates(t: Tables) -> DataFrame:
    rows = t.events.select("event_id", "user_id", "ts", "event_type")
    result = rate_limit(rows, "user_id", "ts", "event_id", EVERYTHING, CLICKS, F.col("event_type") == "click")
    return result.select("event_id", "allowed")


@query("request_counts", """
SELECT user_id, CAST(epoch(date_trunc('day', ts)) AS BIGINT) AS window_start, count(*) AS n_requests, count(*) > 3 AS breach FROM events GROUP BY 1, 2
""")
def counts(t: Tables) -> DataFrame:
    return request_counts(t.events.select("user_id", "ts"), "user_id", "ts", "1 day", budget=3)
