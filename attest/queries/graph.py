"""Integrity and coverage."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attest.operators.graph import (
    coverage,
    dangling_edges,
    expect_matrix,
    extract_items,
    first_membership,
    fold_captures,
    match_by_suffix,
    missing_required,
    outside_allowlist,
    resolve_edges,
    uncovered,
)
from attest.plans.screens import evidence_index
from attest.operators.lookup import outside_table
from attest.plans.captures import CAPTURE_DIMENSIONS, capture_import
from attest.queries.registry import Tables, query
from attest.session import fresh_folder
from attest.sources.versions import published

EVENT_TYPES = ["view", "click", "signup", "error", "purchase"]
HOURS = [f"{h:02d}" for h in range(24)]


def small_parts(t: Tables) -> DataFrame:
    """Every part; the key of a large one is moved below zero, so that no line item refers to it."""
    key = F.col("p_partkey")
    return t.part.select(F.when(F.col("p_size") <= 40, key).otherwise(-key - 1).alias("p_partkey"))


@query("dangling_edges", """
SELECT l_partkey, count(*) AS n_edges FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_size <= 40) GROUP BY l_partkey
""")
def unknown_parts(t: Tables) -> DataFrame:
    return dangling_edges(t.lineitem, small_parts(t), "l_partkey", "p_partkey")


@query("dangling_links", r"""
WITH l AS (SELECT page_id, unnest(regexp_extract_all(html, 'href="(/[^"]*)"', 1)) AS target FROM pages)
SELECT target, count(*) AS n_edges FROM l WHERE target NOT IN (SELECT regexp_extract(url, '^[a-z]+://[^/]+(/[^?#]*)', 1) FROM pages) GROUP BY target
""")
def unknown_links(t: Tables) -> DataFrame:
    links = extract_items(t.pages.select("page_id", "html"), "html", r'href="(/[^"]*)"', "target").select("target")
    paths = t.pages.select(F.regexp_extract("url", r"\A[a-z]+://[^/]+(/[^?#]*)", 1).alias("path"))
    return dangling_edges(links, paths, "target", "path")


@query("resolve_edges", """
SELECT l_orderkey, l_partkey, known, count(*) AS n_rows FROM (
  SELECT l_orderkey, l_partkey, l_partkey IN (SELECT p_partkey FROM part WHERE p_size <= 40) AS known FROM lineitem) GROUP BY ALL
""")
def resolved(t: Tables) -> DataFrame:
    edges = t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey")
    rows = resolve_edges(edges, small_parts(t), "l_partkey", "p_partkey")
    return rows.groupBy("l_orderkey", "l_partkey", "known").agg(F.count(F.lit(1)).alias("n_rows"))


@query("uncovered", """
SELECT p_partkey, p_name FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity >= 49)
""")
def uncovered_parts(t: Tables) -> DataFrame:
    key = F.col("l_partkey")
    members = t.lineitem.select(F.when(F.col("l_quantity") >= 49, key).otherwise(-key - 1).alias("l_partkey"))
    return uncovered(t.part.select("p_partkey", "p_name"), members, "p_partkey", "l_partkey")


@query("coverage", """
SELECT (SELECT count(p_partkey) FROM part) AS n_nodes, (SELECT count(DISTINCT l_partkey) FROM lineitem) AS n_members,
       (SELECT count(p_partkey) FROM part) = (SELECT count(DISTINCT l_partkey) FROM lineitem) AS covered
""")
def part_coverage(t: Tables) -> DataFrame:
    return coverage(t.part, t.lineitem, "p_partkey", "l_partkey")


@query("match_by_suffix", """
SELECT p_partkey, CASE WHEN p_size < 40 THEN concat(p_name, ' ', p_partkey, '.png') END AS matched_file, p_size < 40 AS found FROM part
""")
def matched_files(t: Tables) -> DataFrame:
    name = F.concat("p_name", F.lit(" "), F.col("p_partkey").cast("string"),
                    F.when(F.col("p_size") < 40, ".png").otherwise(".jpg"))
    files = t.part.select(name.alias("file"))
    return match_by_suffix(t.part.select("p_partkey"), files, "p_partkey", "file")


@query("expect_matrix", """
WITH s AS (SELECT user_id, CASE WHEN user_id < 75 THEN 'browser' ELSE 'manual' END AS evidence, min(epoch_us(ts)) + 86400000000 * 5 AS started FROM events GROUP BY user_id),
x AS (SELECT s.*, t.event_type, h.hour FROM s CROSS JOIN (SELECT unnest(['view', 'click', 'signup', 'error', 'purchase']) AS event_type) t
      CROSS JOIN (SELECT lpad(CAST(unnest(range(24)) AS VARCHAR), 2, '0') AS hour) h),
c AS (SELECT user_id, event_type, strftime(ts, '%H') AS hour, count(*) AS n, min(epoch_us(ts)) AS taken FROM events GROUP BY ALL)
SELECT x.user_id, x.event_type, x.hour, coalesce(n, 0) AS n_captures,
  CASE WHEN n IS NULL THEN 'missing' WHEN n > 1 THEN 'ambiguous' WHEN evidence <> 'browser' THEN 'metadata' WHEN taken < started THEN 'stale' ELSE 'ok' END AS verdict
FROM x LEFT JOIN c USING (user_id, event_type, hour)
""")
def matrix(t: Tables) -> DataFrame:
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    states = t.events.groupBy("user_id").agg((F.min(micros) + 86_400_000_000 * 5).alias("started")).withColumn(
        "evidence", F.when(F.col("user_id") < 75, "browser").otherwise("manual")
    )
    captures = t.events.select("user_id", "event_type", F.date_format("ts", "HH").alias("hour"), micros.alias("taken"),
                               F.lit("browser").alias("evidence"))
    result = expect_matrix(states, captures, "user_id", {"event_type": EVENT_TYPES, "hour": HOURS},
                           metadata="evidence", taken_at="taken", started_at="started")
    return result.select("user_id", "event_type", "hour", "n_captures", "verdict")


@query("fold_captures", """
WITH c AS (SELECT user_id, concat(event_type, '-', CASE WHEN hour(ts) < 12 THEN 'am' ELSE 'pm' END) AS k, max(event_id) AS v, count(*) AS n FROM events GROUP BY ALL)
SELECT user_id, CAST(sum(n) AS BIGINT) AS n_captures, concat('{', string_agg(concat('"', k, '":', v), ',' ORDER BY k), '}') AS captures FROM c GROUP BY user_id
""")
def folded(t: Tables) -> DataFrame:
    rows = t.events.withColumn("half", F.when(F.hour("ts") < 12, "am").otherwise("pm"))
    result = fold_captures(rows, ["user_id"], {"event_type": sorted(EVENT_TYPES), "half": ["am", "pm"]}, "event_id")
    return result.withColumn("captures", F.to_json("captures"))


@query("capture_import", """
WITH d AS (SELECT translate(CAST(doc_id AS VARCHAR), '0123456789', 'abcdefghij') AS state, coalesce(lang, '-') AS evidence, doc_id FROM documents),
c AS (SELECT d.*, concat(v, '-', h) AS k FROM d CROSS JOIN (SELECT unnest(['compact', 'phone', 'tablet', 'desktop']) AS v) CROSS JOIN (SELECT unnest(['light', 'dark']) AS h))
SELECT state, evidence, count(*) AS n_captures, concat('{', string_agg(concat('"', k, '":"', doc_id, '/', k, '"'), ',' ORDER BY k), '}') AS captures FROM c GROUP BY ALL
""")
def imported_captures(t: Tables) -> DataFrame:
    """Two imports: the captures of every document, and then a set that has each of them twice, which is refused."""
    state = F.translate(F.col("doc_id").cast("string"), "0123456789", "abcdefghij").alias("state")
    states = t.documents.select(state, F.coalesce("lang", F.lit("-")).alias("evidence"), "doc_id")
    captures = states.withColumn("at", F.col("doc_id") + 1)
    for name, values in CAPTURE_DIMENSIONS.items():
        captures = captures.withColumn(name, F.explode(F.array(*[F.lit(v) for v in values])))
    columns = {
        "evidence": "evidence", "taken_at": "at", "started_at": F.col("doc_id"), "outcome": F.lit("expected"),
        "file": F.concat(F.col("doc_id").cast("string"), F.lit("/"), "viewport", F.lit("-"), "theme"),
    }
    folder = fresh_folder(t.spark, "captures")
    for given in (captures, captures.unionByName(captures)):
        capture_import(t.spark, folder, states, given, t.labels, "state", **columns)
    keys = F.array_sort(F.map_keys("captures"))
    ordered = F.map_from_arrays(keys, F.transform(keys, lambda k: F.element_at("captures", k)))
    return published(t.spark, folder, "states").select("state", "evidence", "n_captures", F.to_json(ordered).alias("captures"))


WORDS = r"([\p{L}\p{N}]+)"


@query("missing_required", r"""
WITH r AS (SELECT DISTINCT unnest(regexp_extract_all(text, '[\p{L}\p{N}]+')) AS item FROM benchmark),
     p AS (SELECT DISTINCT unnest(regexp_extract_all(CASE WHEN lang = 'en' THEN reverse(text) ELSE text END, '[\p{L}\p{N}]+')) AS item FROM documents)
SELECT item FROM r WHERE item NOT IN (SELECT item FROM p)
""")
def missing_words(t: Tables) -> DataFrame:
    required = extract_items(t.benchmark.select("text"), "text", WORDS).select("item").distinct()
    # English texts are read backwards, so they hold few of the words.
    other = t.documents.select(F.when(F.col("lang") == "en", F.reverse("text")).otherwise(F.col("text")).alias("text"))
    return missing_required(required, extract_items(other, "text", WORDS), "item")


@query("outside_allowlist", r"""
SELECT page_id, path, CASE WHEN regexp_matches(path, '(?:\.html|/7[0-9]*)$') THEN 'forbidden' ELSE 'unexpected' END AS reason
FROM (SELECT page_id, regexp_extract(url, '^[a-z]+://[^/]+([^?#]*)', 1) AS path FROM pages)
WHERE regexp_matches(path, '(?:\.html|/7[0-9]*)$') OR NOT (path IN ('/de/1', '/fr/825') OR starts_with(path, '/en/'))
""")
def unexpected_paths(t: Tables) -> DataFrame:
    rows = t.pages.select("page_id", F.regexp_extract("url", r"\A[a-z]+://[^/]+([^?#]*)", 1).alias("path"))
    return outside_allowlist(rows, "path", ["/de/1", "/fr/825"], ["/en/"], r"(?:\.html|/7[0-9]*)\z")


@query("first_membership", """
WITH f AS (SELECT l_partkey, min(l_orderkey) AS o FROM lineitem GROUP BY l_partkey)
SELECT p_partkey, p_type AS state_category, CAST(o AS VARCHAR) AS p_type FROM part LEFT JOIN f ON l_partkey = p_partkey
""")
def first_journeys(t: Tables) -> DataFrame:
    members = t.lineitem.select(
        F.col("l_partkey").alias("p_partkey"), F.col("l_orderkey").cast("string").alias("title"), "l_orderkey"
    )
    nodes = t.part.select("p_partkey", "p_type")
    return first_membership(nodes, members, "p_partkey", "title", "l_orderkey", "p_type")


@query("evidence_index", """
WITH m AS (SELECT doc_id AS position, concat(source, '/', doc_id) AS title, unnest([concat(CASE WHEN lang = 'en' THEN '-' ELSE '' END, n_chars), concat(CASE WHEN lang = 'en' THEN '-' ELSE '' END, doc_id)]) AS node FROM documents)
SELECT doc_id AS index, lang AS state_category, f.title AS category FROM documents
LEFT JOIN (SELECT node, arg_min(title, position) AS title FROM m GROUP BY node) f ON f.node = CAST(doc_id AS VARCHAR)
""")
def indexed_screens(t: Tables) -> DataFrame:
    number = F.col("doc_id").cast("string")
    screens = t.documents.select(
        F.col("doc_id").alias("index"), number.alias("id"), F.col("lang").alias("category"),
        F.array(F.struct(F.col("n_chars").cast("string").alias("to"))).alias("transitions"),
    )
    # The journeys of English documents lead to screens that are not there.
    away = F.when(F.col("lang") == "en", "-").otherwise("")
    journeys = t.documents.select(
        F.col("doc_id").alias("position"),
        F.concat("source", F.lit("/"), number).alias("title"),
        F.array(F.concat(away, F.col("n_chars").cast("string")), F.concat(away, number)).alias("nodes"),
    )
    return evidence_index(screens, journeys)["screens"].select("index", "state_category", "category")


@query("outside_table", r"""
WITH p AS (SELECT page_id, regexp_extract(url, '^[a-z]+://[^/]+([^?#]*)', 1) AS path FROM pages),
i AS (SELECT page_id, path FROM p UNION ALL SELECT page_id, upper(path) FROM p),
r AS (SELECT DISTINCT CASE WHEN starts_with(path, '/de/') THEN path ELSE left(path, 5) END AS route, starts_with(path, '/de/') AS exact FROM p)
SELECT page_id, path, CASE WHEN regexp_matches(path, '/7[0-9]*$') THEN 'forbidden' ELSE 'unexpected' END AS reason
FROM i WHERE regexp_matches(path, '/7[0-9]*$') OR NOT EXISTS (SELECT 1 FROM r WHERE (exact AND route = path) OR (NOT exact AND starts_with(path, route)))
""")
def unexpected_by_table(t: Tables) -> DataFrame:
    paths = t.pages.select("page_id", F.regexp_extract("url", r"\A[a-z]+://[^/]+([^?#]*)", 1).alias("path"))
    exact = F.startswith(F.col("path"), F.lit("/de/"))
    allowed = paths.select(F.when(exact, F.col("path")).otherwise(F.left("path", F.lit(5))).alias("route"), exact.alias("exact")).distinct()
    return outside_table(paths.unionByName(paths.withColumn("path", F.upper("path"))), "path", allowed, r"/7[0-9]*\z")
