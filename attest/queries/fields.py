"""Predicates and text rules."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attest.functions.columns import WORD_END, WORD_START
from attest.functions.content import byte_length, digest
from attest.functions.predicates import PathPolicy, check_origin, classify_path, field_rule, is_hex, is_safe_name, is_version
from attest.functions.state import map_run_state
from attest.functions.text import (
    Secret,
    describe_run,
    document_rewrites,
    extract_code,
    first_line,
    parse_change_title,
    redact,
    rewrite_path,
)
from attest.operators.secrets import redact_table
from attest.queries.registry import Tables, query

HEX_SHAPE = "[0-9A-Fa-f]{32,64}"
HEX_TOKEN = rf"\b{HEX_SHAPE}\b"


@query("is_hex", rf"""
SELECT doc_id, token,
       regexp_matches(token, '\A[0-9a-f]{{40}}\z') AS commit_hex,
       regexp_matches(token, '\A[0-9a-fA-F]{{40}}\z') AS commit_any_case,
       regexp_matches(token, '\A[0-9a-f]{{64}}\z') AS digest_hex,
       regexp_matches(token, '\A[0-9a-f]{{32}}\z') AS task_hex,
       regexp_matches(token || chr(10), '\A[0-9a-f]{{40}}\z') AS with_newline
FROM (SELECT doc_id, unnest(list_distinct(regexp_extract_all(text, '{HEX_TOKEN}') || [sha256(text)])) AS token
      FROM documents)
""")
def hex_tokens(t: Tables) -> DataFrame:
    found = F.regexp_extract_all("text", F.lit(f"{WORD_START}{HEX_SHAPE}{WORD_END}"), F.lit(0))
    tokens = t.documents.select(
        "doc_id", F.explode(F.array_distinct(F.concat(found, F.array(digest("text"))))).alias("token")
    )
    return tokens.select(
        "doc_id",
        "token",
        is_hex("token", 40).alias("commit_hex"),
        is_hex("token", 40, ignore_case=True).alias("commit_any_case"),
        is_hex("token", 64).alias("digest_hex"),
        is_hex("token", 32).alias("task_hex"),
        is_hex(F.concat("token", F.lit("\n")), 40).alias("with_newline"),
    )


VERSION_SQL = """
SELECT l_orderkey, l_linenumber, version, count(*) AS n_rows,
  bool_and(regexp_matches(version, '\\A(?:0|[1-9][0-9]*)\\.(?:0|[1-9][0-9]*)\\.(?:0|[1-9][0-9]*)(?:-(?:alpha|beta|rc)\\.(?:0|[1-9][0-9]*))?\\z')) AS strict,
  bool_and(regexp_matches(version, '\\A[0-9]+\\.[0-9]+\\.[0-9]+(?:-[0-9A-Za-z.-]+)?\\z')) AS release,
  bool_and(regexp_matches('v' || version, '\\Av[0-9]+\\.[0-9]+\\.[0-9]+(?:-[0-9A-Za-z.-]+)?\\z')) AS tag,
  bool_and(regexp_matches('refs/tags/v' || version, '\\A(?:refs/heads/release|refs/tags/v[0-9]+\\.[0-9]+\\.[0-9]+(?:-[0-9A-Za-z.-]+)?)\\z')) AS mirror
FROM (SELECT l_orderkey, l_linenumber,
        CASE l_returnflag
          WHEN 'A' THEN concat(l_linenumber, '.', l_suppkey, '.', l_partkey)
          WHEN 'R' THEN concat('0', l_linenumber, '.', l_suppkey, '.', l_partkey, '-rc.', l_suppkey)
          ELSE concat(l_linenumber, '.', l_suppkey, '.', l_partkey, '-', CASE l_linestatus WHEN 'F' THEN 'beta.' ELSE 'b_ta.' END, l_linenumber)
        END AS version
      FROM lineitem)
GROUP BY ALL
"""


@query("is_version", VERSION_SQL)
def versions(t: Tables) -> DataFrame:
    plain = F.concat_ws(".", "l_linenumber", "l_suppkey", "l_partkey")
    version = (
        F.when(F.col("l_returnflag") == "A", plain)
        .when(F.col("l_returnflag") == "R", F.concat(F.lit("0"), plain, F.lit("-rc."), "l_suppkey"))
        .otherwise(F.concat(plain, F.lit("-"), F.when(F.col("l_linestatus") == "F", "beta.").otherwise("b_ta."),
                            "l_linenumber"))
    )
    rows = t.lineitem.select("l_orderkey", "l_linenumber", version.alias("version"))
    return rows.groupBy("l_orderkey", "l_linenumber", "version").agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.bool_and(is_version("version", "strict")).alias("strict"),
        F.bool_and(is_version("version", "release")).alias("release"),
        F.bool_and(is_version(F.concat(F.lit("v"), "version"), "tag")).alias("tag"),
        F.bool_and(is_version(F.concat(F.lit("refs/tags/v"), "version"), "mirror")).alias("mirror"),
    )


@query("is_safe_name", r"""
SELECT page_id, name, regexp_matches(name, '\A[a-zA-Z0-9._-]+\z') AND name NOT IN ('.', '..') AS safe
FROM (SELECT page_id, regexp_extract(url, '[^/]*$') AS name FROM pages
      UNION ALL SELECT page_id, '..' AS name FROM pages)
""")
def safe_names(t: Tables) -> DataFrame:
    names = t.pages.select("page_id", F.element_at(F.split("url", "/"), -1).alias("name"))
    names = names.unionByName(t.pages.select("page_id", F.lit("..").alias("name")))
    return names.withColumn("safe", is_safe_name("name"))


# Hosts the origin check accepts in this query: an allow-list is configuration.
ALLOWED_HOSTS = [
    "www.ththwh.example.org",
    "www.ththhe.example.com",
    "www.ththti.example.com",
    "www.therst.example.com",
    "www.therti.example.org",
    "therea.example.net",
    "ththre.example.com",
    "ththing.example.net",
    "blog.ththes.example.com",
    "m.ththor.example.net",
]
ORIGIN_SQL = r"""
WITH u AS (
  SELECT page_id, url AS origin FROM pages
  UNION ALL SELECT page_id, regexp_extract(url, '^[a-z]+://[^/]+') FROM pages
  UNION ALL SELECT page_id, regexp_extract(url, '^[a-z]+://[^/]+') || ':443/' FROM pages
  UNION ALL SELECT page_id, regexp_extract(url, '^[a-z]+://[^/]+') || ':8443' FROM pages
  UNION ALL SELECT page_id, replace(regexp_extract(url, '^[a-z]+://[^/]+'), '://', '://user:pw@') FROM pages
  UNION ALL SELECT page_id, regexp_extract(url, '^[a-z]+://[^/]+') || '?q=' || page_id FROM pages
  UNION ALL SELECT page_id, '' FROM pages
), p AS (
  SELECT *, split_part(origin, '://', 1) AS scheme,
         regexp_extract(origin, '^[a-z]+://([^/?#]*)', 1) AS authority,
         regexp_extract(origin, '^[a-z]+://[^/?#]*([^?#]*)', 1) AS path,
         regexp_extract(origin, '\?([^#]*)', 1) AS q,
         regexp_extract(origin, '#(.*)$', 1) AS frag
  FROM u
)
SELECT page_id, origin,
  CASE WHEN origin = '' THEN NULL
       WHEN scheme <> 'https' THEN 'protocol'
       WHEN regexp_replace(regexp_replace(authority, '^.*@', ''), ':443$', '') NOT IN (HOSTS) THEN 'host'
       WHEN contains(authority, '@') THEN 'credentials'
       WHEN q <> '' THEN 'query'
       WHEN path NOT IN ('', '/') THEN 'path'
       WHEN frag <> '' THEN 'fragment' END AS problem
FROM p
""".replace("HOSTS", ", ".join(f"'{h}'" for h in ALLOWED_HOSTS))


@query("check_origin", ORIGIN_SQL)
def origins(t: Tables) -> DataFrame:
    site = F.regexp_extract("url", r"\A[a-z]+://[^/]+", 0)
    forms = F.array(
        F.col("url"),
        site,
        F.concat(site, F.lit(":443/")),
        F.concat(site, F.lit(":8443")),
        F.replace(site, F.lit("://"), F.lit("://user:pw@")),
        F.concat(site, F.lit("?q="), F.col("page_id").cast("string")),
        F.lit(""),
    )
    rows = t.pages.select("page_id", F.explode(forms).alias("origin"))
    return rows.withColumn("problem", check_origin("origin", ALLOWED_HOSTS))


@query("field_rule", r"""
SELECT s_suppkey AS id, 'supplier' AS kind,
       s_suppkey BETWEEN 1 AND 65535 AS port, s_suppkey * 100 BETWEEN 1025 AND 65535 AS unprivileged,
       regexp_matches('127.0.0.1:' || s_suppkey, '\A127\.0\.0\.1:[0-9]{1,5}\z') AS loopback,
       regexp_matches(s_name, '\A[a-zA-Z0-9][a-zA-Z0-9.-]*\z') AS host,
       regexp_matches('/' || replace(s_name, '#', '/'), '\A/[a-zA-Z0-9/_.-]+\z') AS absolute_path,
       regexp_matches(lower(replace(s_name, '#', '-')), '\A[a-z][a-z0-9-]+\z') AS service_name,
       regexp_matches(concat('db:', s_nationkey, '.', s_suppkey), '\Adb:[a-zA-Z0-9_.-]+\z') AS image_pin,
       regexp_matches(replace(s_name, '#', '@') || '.test', '\A[^@\s]+@[^@\s]+\.[^@\s]+\z') AS email,
       NOT contains(concat('smtps://', s_name, CASE WHEN s_acctbal < 5000 THEN '?skip_ssl_verify=true' ELSE '' END), 'skip_ssl_verify=true') AS smtp_uri,
       length(s_name) BETWEEN 1 AND 12 AS short_name
FROM supplier
UNION ALL
SELECT c_custkey, 'customer',
       c_custkey BETWEEN 1 AND 65535, c_custkey * 100 BETWEEN 1025 AND 65535,
       regexp_matches('127.0.0.1:' || c_custkey, '\A127\.0\.0\.1:[0-9]{1,5}\z'),
       regexp_matches(c_name, '\A[a-zA-Z0-9][a-zA-Z0-9.-]*\z'),
       regexp_matches('/' || replace(c_name, '#', '/'), '\A/[a-zA-Z0-9/_.-]+\z'),
       regexp_matches(lower(replace(c_name, '#', '-')), '\A[a-z][a-z0-9-]+\z'),
       regexp_matches(concat('db:', c_nationkey, '.', c_custkey), '\Adb:[a-zA-Z0-9_.-]+\z'),
       regexp_matches(replace(c_name, '#', '@') || '.test', '\A[^@\s]+@[^@\s]+\.[^@\s]+\z'),
       NOT contains(concat('smtps://', c_name, CASE WHEN c_acctbal < 5000 THEN '?skip_ssl_verify=true' ELSE '' END), 'skip_ssl_verify=true'),
       length(c_name) BETWEEN 1 AND 12
FROM customer
""")
def field_shapes(t: Tables) -> DataFrame:
    def party(df: DataFrame, letter: str, key: str, kind: str) -> DataFrame:
        return df.select(
            F.col(key).alias("id"), F.lit(kind).alias("kind"), F.col(f"{letter}_name").alias("name"),
            F.col(f"{letter}_nationkey").alias("nation"), F.col(f"{letter}_acctbal").alias("balance"),
        )

    rows = party(t.supplier, "s", "s_suppkey", "supplier").unionByName(party(t.customer, "c", "c_custkey", "customer"))
    name, number = F.col("name"), F.col("id").cast("string")
    flag = F.when(F.col("balance") < 5000, "?skip_ssl_verify=true").otherwise("")
    return rows.select(
        "id",
        "kind",
        field_rule("port", number).alias("port"),
        field_rule("unprivileged_port", (F.col("id") * 100).cast("string")).alias("unprivileged"),
        field_rule("loopback", F.concat(F.lit("127.0.0.1:"), number)).alias("loopback"),
        field_rule("host", name).alias("host"),
        field_rule("absolute_path", F.concat(F.lit("/"), F.replace(name, F.lit("#"), F.lit("/")))).alias("absolute_path"),
        field_rule("service_name", F.lower(F.replace(name, F.lit("#"), F.lit("-")))).alias("service_name"),
        field_rule("image_pin", F.concat(F.lit("db:"), "nation", F.lit("."), number), repository="db").alias("image_pin"),
        field_rule("email", F.concat(F.replace(name, F.lit("#"), F.lit("@")), F.lit(".test"))).alias("email"),
        field_rule("smtp_uri", F.concat(F.lit("smtps://"), name, flag)).alias("smtp_uri"),
        field_rule("short_name", name, limit=12).alias("short_name"),
    )


PATH_SQL = r"""
WITH p AS (
  SELECT page_id AS id, regexp_extract(url, '^[a-z]+://[^/]+/([^?#]*)', 1) AS path FROM pages
  UNION ALL
  SELECT event_id, CASE event_type
      WHEN 'view' THEN concat('app/', user_id, CASE WHEN value < 20 THEN '.key' ELSE '.keys' END)
      WHEN 'click' THEN concat('web/.env', CASE WHEN value < 10 THEN '' WHEN value < 20 THEN '.local' ELSE '.example' END)
      WHEN 'signup' THEN concat(CASE WHEN value < 10 THEN 'vault/' ELSE 'public/' END, user_id, '/state', CASE WHEN value > 30 THEN '.sqlite3' ELSE '.txt' END)
      WHEN 'error' THEN concat('infra/', CASE WHEN value < 15 THEN '.terraform/' ELSE '' END, user_id, CASE WHEN value > 25 THEN '.private.json' ELSE '.p12' END)
      ELSE concat('handbook/ch', user_id, '/draft.txt') END
  FROM events
), n AS (SELECT *, regexp_extract(path, '[^/]*$') AS name FROM p)
SELECT id, path, CASE
  WHEN path IN ('app/7.keys', 'web/.env.example') THEN 'exact'
  WHEN starts_with(path, 'vault/') OR starts_with(path, 'drafts/') THEN 'prefix'
  WHEN regexp_matches(path, '\Ahandbook/ch[1-7]/[a-z]+\.txt\z') THEN 'path_pattern'
  WHEN regexp_matches(name, '\A3.*[.]txt\z') THEN 'name_pattern'
  WHEN contains(name, '.private.') THEN 'private_marker'
  WHEN name = '.env' OR (starts_with(name, '.env.') AND NOT ends_with(name, '.example')) THEN 'environment'
  WHEN regexp_matches(name, '\.(?:key|pem|tfstate)(?:\.|\z)') THEN 'key_or_state'
  WHEN regexp_matches(name, '\.(?:sqlite3?|db|dump|sql\.gz)\z') THEN 'database'
  WHEN regexp_matches(name, '\.(?:jks|keystore|p12|pfx)\z') THEN 'keystore'
  WHEN name IN ('local.properties', 'kubeconfig', 'talosconfig') THEN 'name'
  WHEN list_contains(string_split(path, '/'), '.terraform') THEN 'segment' END AS rule
FROM n
"""


@query("classify_path", PATH_SQL)
def paths(t: Tables) -> DataFrame:
    user, value, kind = F.col("user_id").cast("string"), F.col("value"), F.col("event_type")
    built = (
        F.when(kind == "view", F.concat(F.lit("app/"), user, F.when(value < 20, ".key").otherwise(".keys")))
        .when(kind == "click", F.concat(F.lit("web/.env"),
                                        F.when(value < 10, "").when(value < 20, ".local").otherwise(".example")))
        .when(kind == "signup", F.concat(F.when(value < 10, "vault/").otherwise("public/"), user, F.lit("/state"),
                                         F.when(value > 30, ".sqlite3").otherwise(".txt")))
        .when(kind == "error", F.concat(F.lit("infra/"), F.when(value < 15, ".terraform/").otherwise(""), user,
                                        F.when(value > 25, ".private.json").otherwise(".p12")))
        .otherwise(F.concat(F.lit("handbook/ch"), user, F.lit("/draft.txt")))
    )
    from_pages = t.pages.select(
        F.col("page_id").alias("id"), F.regexp_extract("url", r"\A[a-z]+://[^/]+/([^?#]*)", 1).alias("path")
    )
    rows = from_pages.unionByName(t.events.select(F.col("event_id").alias("id"), built.alias("path")))
    policy = PathPolicy(
        exact=("app/7.keys", "web/.env.example"), prefixes=("vault/", "drafts/"),
        path_patterns=(r"\Ahandbook/ch[1-7]/[a-z]+\.txt\z",), name_patterns=(r"\A3.*[.]txt\z",),
    )
    return rows.withColumn("rule", classify_path("path", policy))


TITLE_SQL = r"""
WITH m AS (
  SELECT doc_id, lang,
    concat(CASE lang WHEN 'en' THEN '✨' WHEN 'fr' THEN '🐛' WHEN 'de' THEN '♻️' ELSE '⚡' END, ' [v',
           CASE WHEN n_chars < 200 THEN '01.2.3' WHEN n_chars < 400 THEN '1.2.4' ELSE '1.2.3' END, '] ',
           CASE lang WHEN 'en' THEN 'feat' WHEN 'fr' THEN 'fix' WHEN 'de' THEN 'refactor' ELSE 'test' END,
           CASE WHEN n_chars > 3000 THEN concat('(', source, ')!') ELSE '' END, ': ',
           regexp_extract(text, '\A[^\r\n]*'), chr(10), 'body') AS message
  FROM documents
), s AS (SELECT doc_id, lang, regexp_extract(message, '\A[^\r\n]*') AS subject FROM m),
g AS (
  SELECT doc_id, lang, subject, regexp_matches(subject, '\A\S+ \[v[^\]]+\] [a-z]+(?:\([a-z0-9][a-z0-9/-]*\))?!?: \S.*\z') AS shaped,
    regexp_extract(subject, '\A\S+ \[v([^\]]+)\] ', 1) AS version,
    regexp_extract(subject, '\A\S+ \[v[^\]]+\] ([a-z]+)', 1) AS type,
    regexp_extract(subject, '\A\S+ \[v[^\]]+\] [a-z]+\(([a-z0-9][a-z0-9/-]*)\)', 1) AS scope,
    regexp_matches(subject, '\A\S+ \[v[^\]]+\] [a-z]+(?:\([a-z0-9][a-z0-9/-]*\))?!: ') AS breaking
  FROM s
)
SELECT doc_id,
  CASE WHEN shaped THEN version ELSE '' END AS version, CASE WHEN shaped THEN type ELSE '' END AS type,
  CASE WHEN shaped THEN scope ELSE '' END AS scope, shaped AND breaking AS breaking,
  CASE WHEN NOT shaped THEN 'shape'
       WHEN lang NOT IN ('en', 'fr', 'de') THEN 'emoji'
       WHEN version <> '1.2.3' THEN 'version'
       WHEN length(subject) > 100 THEN 'length'
       WHEN regexp_matches(subject, '[\s  　﻿]\z') THEN 'outer_space' END AS problem
FROM g
"""


@query("parse_change_title", TITLE_SQL)
def change_titles(t: Tables) -> DataFrame:
    lang, n = F.col("lang"), F.col("n_chars")
    emoji = F.when(lang == "en", "✨").when(lang == "fr", "\U0001f41b").when(lang == "de", "♻️").otherwise("⚡")
    kind = F.when(lang == "en", "feat").when(lang == "fr", "fix").when(lang == "de", "refactor").otherwise("test")
    version = F.when(n < 200, "01.2.3").when(n < 400, "1.2.4").otherwise("1.2.3")
    scope = F.when(n > 3000, F.concat(F.lit("("), "source", F.lit(")!"))).otherwise("")
    message = F.concat(emoji, F.lit(" [v"), version, F.lit("] "), kind, scope, F.lit(": "), first_line("text"),
                       F.lit("\nbody"))
    title = parse_change_title(message, F.lit("1.2.3"))
    return t.documents.select("doc_id", title.alias("t")).select(
        "doc_id", "t.version", "t.type", "t.scope", "t.breaking", "t.problem"
    )


# Shapes found in the test documents: addresses, commit ids and dotted quads.
DOCUMENT_PATTERNS = (
    Secret(r"[a-z0-9._%+-]+@[a-z0-9.-]+\.[a-z]{2,}", needs=("@",)),
    rf"{WORD_START}[0-9a-f]{{40}}{WORD_END}",
    rf"{WORD_START}[0-9]{{1,3}}(?:\.[0-9]{{1,3}}){{3}}{WORD_END}",
)


@query("redact", r"""
SELECT doc_id, sha256(redacted) AS redacted_sha256,
       (length(redacted) - length(replace(redacted, '[REDACTED]', ''))) // 10 AS n_masks
FROM (SELECT doc_id,
  regexp_replace(regexp_replace(regexp_replace(replace(text, 'theouble', '[REDACTED]'),
    '[a-z0-9._%+-]+@[a-z0-9.-]+\.[a-z]{2,}', '[REDACTED]', 'gi'),
    '\b[0-9a-f]{40}\b', '[REDACTED]', 'gi'),
    '\b[0-9]{1,3}(?:\.[0-9]{1,3}){3}\b', '[REDACTED]', 'gi') AS redacted FROM documents)
""")
def redacted(t: Tables) -> DataFrame:
    masked = redact("text", literals=["theouble", "the"], patterns=DOCUMENT_PATTERNS)
    rows = t.documents.select("doc_id", masked.alias("r"))
    gone = F.char_length("r") - F.char_length(F.replace("r", F.lit("[REDACTED]"), F.lit("")))
    return rows.select("doc_id", digest("r").alias("redacted_sha256"), (gone / 10).cast("bigint").alias("n_masks"))


# Known secrets: every long word of digits and letters of the documents, and the beginnings of the benchmark's passages.
@query("redact_table", r"""
WITH s AS (SELECT DISTINCT secret FROM (SELECT unnest(regexp_extract_all(text, '[A-Za-z0-9_]*[0-9][A-Za-z0-9_]{11,}')) AS secret FROM documents
                                        UNION ALL SELECT left(text, 30) FROM benchmark) WHERE length(secret) > 3),
h AS (SELECT doc_id, any_value(text) AS text, list(secret ORDER BY length(secret) DESC, secret) AS secrets FROM documents JOIN s ON contains(text, secret) GROUP BY doc_id),
m AS (SELECT doc_id, CASE WHEN h.doc_id IS NULL THEN d.text ELSE list_reduce(list_prepend(d.text, secrets), lambda a, x: replace(a, x, '[REDACTED]')) END AS redacted
      FROM documents d LEFT JOIN h USING (doc_id))
SELECT doc_id, sha256(redacted) AS redacted_sha256, (length(redacted) - length(replace(redacted, '[REDACTED]', ''))) // 10 AS n_masks FROM m
""")
def redacted_by_table(t: Tables) -> DataFrame:
    # Most documents have no such word, which the end of the pattern alone tells sooner.
    held = t.documents.where(F.col("text").rlike("[0-9][A-Za-z0-9_]{11}"))
    words = held.select(F.explode(F.regexp_extract_all("text", F.lit("[A-Za-z0-9_]*[0-9][A-Za-z0-9_]{11,}"), F.lit(0))).alias("secret"))
    secrets = words.unionByName(t.benchmark.select(F.left("text", F.lit(30)).alias("secret")))
    masked = redact_table(t.documents.select("doc_id", "text"), "text", secrets, patterns=())
    gone = F.char_length("redacted") - F.char_length(F.replace("redacted", F.lit("[REDACTED]"), F.lit("")))
    return masked.select("doc_id", digest("redacted").alias("redacted_sha256"), (gone / 10).cast("bigint").alias("n_masks"))


STATE_SQL = """
WITH r AS (SELECT event_id, event_type,
    CASE event_type WHEN 'view' THEN 'queued' WHEN 'click' THEN 'in_progress' WHEN 'purchase' THEN 'waiting' ELSE 'completed' END AS status,
    CASE WHEN event_type NOT IN ('signup', 'error') THEN NULL
         WHEN event_type = 'error' THEN CASE WHEN value < 10 THEN 'failure' WHEN value < 20 THEN 'timed_out' WHEN value < 30 THEN 'cancelled' ELSE 'stale' END
         ELSE CASE WHEN value < 10 THEN 'success' WHEN value < 20 THEN 'neutral' WHEN value < 30 THEN 'skipped' ELSE NULL END END AS conclusion
  FROM events)
"""


def _runs(t: Tables) -> DataFrame:
    kind, value = F.col("event_type"), F.col("value")
    status = (
        F.when(kind == "view", "queued").when(kind == "click", "in_progress").when(kind == "purchase", "waiting")
        .otherwise("completed")
    )
    conclusion = F.when(
        kind == "error",
        F.when(value < 10, "failure").when(value < 20, "timed_out").when(value < 30, "cancelled").otherwise("stale"),
    ).when(kind == "signup", F.when(value < 10, "success").when(value < 20, "neutral").when(value < 30, "skipped"))
    return t.events.select("event_id", "event_type", status.alias("status"), conclusion.alias("conclusion"))


@query("map_run_state", STATE_SQL + """
SELECT event_id, CASE status WHEN 'queued' THEN 'pending' WHEN 'in_progress' THEN 'running' WHEN 'completed' THEN
    CASE WHEN conclusion = 'success' THEN 'success' WHEN conclusion IN ('failure', 'timed_out', 'action_required') THEN 'failed'
         WHEN conclusion = 'cancelled' THEN 'canceled' WHEN conclusion IN ('skipped', 'neutral') THEN 'skipped' ELSE 'failed' END
  ELSE 'pending' END AS state FROM r
""")
def run_states(t: Tables) -> DataFrame:
    return _runs(t).select("event_id", map_run_state("status", "conclusion").alias("state"))


@query("describe_run", STATE_SQL + """
SELECT event_id, left(concat('Checks [', event_type, ']: ', status,
       CASE WHEN conclusion IS NULL THEN '' ELSE concat(' (', conclusion, ')') END), 255) AS description FROM r
""")
def run_descriptions(t: Tables) -> DataFrame:
    return _runs(t).select(
        "event_id", describe_run(F.lit("Checks"), "event_type", "status", "conclusion").alias("description")
    )


@query("digest", """
SELECT doc_id, sha256(text) AS sha256, CAST(octet_length(encode(text)) AS BIGINT) AS size FROM documents
""")
def digests(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", digest("text").alias("sha256"), byte_length("text").alias("size"))


@query("extract_code", r"""
SELECT conv_id, turn, nullif(regexp_extract(body, '\b[0-9]{6}\b'), '') AS code
FROM (SELECT conv_id, turn, concat(text, ' ', CASE role WHEN 'user' THEN '12345' ELSE '1234567' END, ' code: ',
             lpad(CAST(conv_id * 7919 + turn AS VARCHAR), 6, '0'), '. 999999') AS body FROM conversations)
""")
def codes(t: Tables) -> DataFrame:
    number = (F.col("conv_id") * 7919 + F.col("turn")).cast("string")
    body = F.concat("text", F.lit(" "), F.when(F.col("role") == "user", "12345").otherwise("1234567"),
                    F.lit(" code: "), F.lpad(number, 6, "0"), F.lit(". 999999"))
    return t.conversations.select("conv_id", "turn", extract_code(body).alias("code"))


@query("first_line", r"SELECT doc_id, regexp_extract(text, '\A(.*?)(?:\r?\n|\z)', 1) AS title FROM documents")
def first_lines(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", first_line("text").alias("title"))


@query("rewrite_path", r"""
SELECT page_id, path, CASE
    WHEN regexp_matches(path, '\A/en((?:/[^/]+)*)\.md\z') THEN regexp_replace(path, '\A/en((?:/[^/]+)*)\.md\z', '/content/en\1/content.md')
    WHEN regexp_matches(path, '\A/en((?:/[^/]+)*)/?\z') THEN regexp_replace(path, '\A/en((?:/[^/]+)*)/?\z', '/content/en\1/content.md')
    ELSE path END AS rewritten
FROM (SELECT page_id, regexp_replace(regexp_extract(url, '^[a-z]+://[^/]+([^?#]*)', 1), '\.html$', '.md') AS path FROM pages)
""")
def rewritten_paths(t: Tables) -> DataFrame:
    path = F.regexp_replace(F.regexp_extract("url", r"\A[a-z]+://[^/]+([^?#]*)", 1), r"\.html\z", ".md")
    rules = document_rewrites("/en", "/content/en", negotiated=True)
    rows = t.pages.select("page_id", path.alias("path"))
    return rows.withColumn("rewritten", rewrite_path("path", rules))
