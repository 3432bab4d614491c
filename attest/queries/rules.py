"""The rule engine, composite checks and group rules."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from attest.functions.content import digest
from attest.functions.text import first_line
from attest.operators.rules import Rule, check, first_failure, split_valid
from attest.operators.sets import (
    same_rows_by_range,
    change_counts,
    combine,
    completeness,
    content_drift,
    duplicates,
    group_rules,
    group_verdict,
    in_order,
    readiness,
    report_gate,
)
from attest.plans.deploy import deploy_check
from attest.plans.identity import conform
from attest.plans.jobs import job_policy, step_order
from attest.plans.schema import schema_violations
from attest.plans.release import build_check, release_check
from attest.plans.screens import evidence_problems, padded, screen_check
from attest.queries.registry import Tables, query
from attest.sources.records import parse_records


@query("check", """
SELECT l_orderkey, l_linenumber, rule, ordinal, value FROM (
  SELECT l_orderkey, l_linenumber, 'quantity' AS rule, CAST(1 AS BIGINT) AS ordinal, CAST(CAST(l_quantity AS BIGINT) AS VARCHAR) AS value
  FROM lineitem WHERE NOT (l_quantity <= 45)
  UNION ALL SELECT l_orderkey, l_linenumber, 'discount', 2, NULL FROM lineitem WHERE NOT (l_discount < 0.1)
  UNION ALL SELECT l_orderkey, l_linenumber, 'flag', 3, l_returnflag FROM lineitem WHERE NOT (l_returnflag <> 'R' OR l_linestatus = 'F')
  UNION ALL SELECT l_orderkey, l_linenumber, 'part', 4, CAST(l_partkey AS VARCHAR) FROM lineitem WHERE NOT (l_partkey > l_suppkey))
""")
def violations(t: Tables) -> DataFrame:
    rules = [
        Rule("quantity", F.col("l_quantity") <= 45, F.col("l_quantity").cast("bigint")),
        Rule("discount", F.col("l_discount") < 0.1),
        Rule("flag", (F.col("l_returnflag") != "R") | (F.col("l_linestatus") == "F"), F.col("l_returnflag")),
        Rule("part", F.col("l_partkey") > F.col("l_suppkey"), F.col("l_partkey")),
    ]
    return check(t.lineitem, rules, ["l_orderkey", "l_linenumber"])


def order_rules() -> list[Rule]:
    return [
        Rule("status", F.col("o_orderstatus").isin("F", "O"), F.col("o_orderstatus")),
        Rule("price", F.col("o_totalprice").between(1000, 400000)),
        Rule("priority", F.col("o_orderpriority") != "5-LOW", F.col("o_orderpriority")),
        Rule("date", F.col("o_orderdate") < F.lit("1998-01-01").cast("timestamp")),
    ]


ORDER_FAILURE = """CASE WHEN NOT o_orderstatus IN ('F', 'O') THEN 'status' WHEN NOT o_totalprice BETWEEN 1000 AND 400000 THEN 'price'
       WHEN NOT o_orderpriority <> '5-LOW' THEN 'priority' WHEN NOT o_orderdate < TIMESTAMP '1998-01-01' THEN 'date' END"""


@query("first_failure", f"SELECT o_orderkey, {ORDER_FAILURE} AS first_failure FROM orders")
def first_failures(t: Tables) -> DataFrame:
    return first_failure(t.orders, order_rules()).select("o_orderkey", "first_failure")


@query("split_valid", f"""
SELECT o_orderkey, {ORDER_FAILURE} IS NULL AS accepted,
  concat_ws(',', CASE WHEN NOT o_orderstatus IN ('F', 'O') THEN 'status' END, CASE WHEN NOT o_totalprice BETWEEN 1000 AND 400000 THEN 'price' END,
     CASE WHEN NOT o_orderpriority <> '5-LOW' THEN 'priority' END, CASE WHEN NOT o_orderdate < TIMESTAMP '1998-01-01' THEN 'date' END) AS broken
FROM orders
""")
def accepted_and_quarantined(t: Tables) -> DataFrame:
    accepted, quarantined = split_valid(t.orders, order_rules())
    return combine(
        accepted.select("o_orderkey", F.lit(True).alias("accepted"), F.lit("").alias("broken")),
        quarantined.select("o_orderkey", F.lit(False).alias("accepted"), F.array_join("broken_rules", ",").alias("broken")),
    )


RELEASE_SQL = r"""
WITH m AS (
  SELECT o_orderkey AS release,
    concat('1.', o_custkey, '.0', CASE WHEN o_orderstatus = 'P' THEN '-rc_1' ELSE '' END) AS version,
    concat(CASE WHEN o_orderpriority = '5-LOW' THEN '' ELSE 'v' END, '1.', o_custkey, '.', CASE WHEN o_orderpriority = '1-URGENT' THEN '1' ELSE '0' END) AS tag,
    left(sha256(concat('r', o_orderkey)), CASE WHEN o_totalprice > 400000 THEN 39 ELSE 40 END) AS ref,
    left(sha256(concat('c', o_custkey)), 40) AS client_sha FROM orders
), f AS (
  SELECT l_orderkey AS release, CAST(l_partkey AS VARCHAR) AS path,
    concat(CASE WHEN l_discount > 0.09 THEN '../' ELSE '' END, l_partkey, '.deb') AS name,
    sha256(CAST(l_partkey AS VARCHAR)) AS sha256, CAST(l_quantity AS BIGINT) AS size FROM lineitem
), a AS (
  SELECT CAST(p_partkey AS VARCHAR) AS path, sha256(concat(p_partkey, CASE WHEN p_type = 'PROMO' THEN 'x' ELSE '' END)) AS sha256,
         CAST(p_size AS BIGINT) AS size FROM part WHERE p_brand <> 'Brand#2'
)
SELECT release, NULL AS item, 'version' AS rule, version AS value FROM m WHERE NOT regexp_matches(version, '\A[0-9]+\.[0-9]+\.[0-9]+(-[0-9A-Za-z.-]+)?\z')
UNION ALL SELECT release, NULL, 'tag', tag FROM m WHERE NOT regexp_matches(tag, '\Av[0-9]+\.[0-9]+\.[0-9]+(-[0-9A-Za-z.-]+)?\z')
UNION ALL SELECT release, NULL, 'tag_matches_version', tag FROM m WHERE tag <> concat('v', version)
UNION ALL SELECT release, NULL, 'ref', ref FROM m WHERE NOT regexp_matches(ref, '\A[0-9a-f]{40}\z')
UNION ALL SELECT release, NULL, 'no_files', NULL FROM m WHERE release NOT IN (SELECT release FROM f)
UNION ALL SELECT release, name, 'name', name FROM f WHERE contains(name, '/')
UNION ALL SELECT f.release, f.name, 'size', CAST(a.size AS VARCHAR) FROM f JOIN a USING (path) WHERE a.size > 48
UNION ALL SELECT release, name, 'duplicate_name', CAST(count(*) AS VARCHAR) FROM f GROUP BY release, name HAVING count(*) > 1
UNION ALL SELECT f.release, f.name, 'missing', NULL FROM f LEFT JOIN a USING (path) WHERE a.path IS NULL
UNION ALL SELECT f.release, f.name, 'size_mismatch', a.sha256 FROM f JOIN a USING (path) WHERE a.size <> f.size
UNION ALL SELECT f.release, f.name, 'digest_mismatch', a.sha256 FROM f JOIN a USING (path) WHERE a.sha256 <> f.sha256
"""


def release_inputs(t: Tables) -> tuple[DataFrame, DataFrame, DataFrame]:
    cust, key = F.col("o_custkey").cast("string"), F.col("o_orderkey").cast("string")
    manifests = t.orders.select(
        F.col("o_orderkey").alias("release"),
        F.concat(F.lit("1."), cust, F.lit(".0"), F.when(F.col("o_orderstatus") == "P", "-rc_1").otherwise("")).alias("version"),
        F.concat(F.when(F.col("o_orderpriority") == "5-LOW", "").otherwise("v"), F.lit("1."), cust, F.lit("."),
                 F.when(F.col("o_orderpriority") == "1-URGENT", "1").otherwise("0")).alias("tag"),
        F.left(digest(F.concat(F.lit("r"), key)), F.when(F.col("o_totalprice") > 400000, 39).otherwise(40)).alias("ref"),
        F.left(digest(F.concat(F.lit("c"), cust)), F.lit(40)).alias("client_sha"),
    )
    part = F.col("l_partkey").cast("string")
    files = t.lineitem.select(
        F.col("l_orderkey").alias("release"),
        part.alias("path"),
        F.concat(F.when(F.col("l_discount") > 0.09, "../").otherwise(""), part, F.lit(".deb")).alias("name"),
        digest(part).alias("sha256"),
        F.col("l_quantity").cast("bigint").alias("size"),
    )
    stored = F.concat(F.col("p_partkey").cast("string"), F.when(F.col("p_type") == "PROMO", "x").otherwise(""))
    # A file that is not there lies at a path that no release names.
    away = F.when(F.col("p_brand") == "Brand#2", "-").otherwise("")
    actual = t.part.select(
        F.concat(away, F.col("p_partkey").cast("string")).alias("path"), digest(stored).alias("sha256"),
        F.col("p_size").cast("bigint").alias("size"),
    )
    return manifests, files, actual


@query("build_check", r"""
WITH b AS (
  SELECT o_orderkey AS build, left(sha256(CAST(o_custkey AS VARCHAR)), 40) AS source_sha, o_orderstatus = 'P' AS moved,
    CASE WHEN o_orderpriority = '1-URGENT' THEN '1.0' WHEN o_orderpriority = '2-HIGH' THEN '1.0.0-rc_1' ELSE '1.0.0' END AS version FROM orders
), f AS (
  SELECT l_orderkey AS build, concat(CASE WHEN l_discount > 0.09 THEN '../' ELSE '' END, 'f', l_linenumber, CASE l_linenumber WHEN 1 THEN '.deb' WHEN 2 THEN '.apk' WHEN 3 THEN '.exe' ELSE '.zip' END) AS name,
    CASE WHEN l_tax > 0.07 THEN l_quantity + 0.5 ELSE l_quantity END AS size,
    CASE WHEN l_linestatus = 'F' THEN sha256(CAST(l_partkey AS VARCHAR)) ELSE upper(sha256(CAST(l_partkey AS VARCHAR))) END AS sha256 FROM lineitem
), g AS (SELECT build, count(*) AS n, count(*) = 3 AND count(DISTINCT right(name, 3)) = 3 AND bool_and(right(name, 4) <> '.zip') AS ok FROM f GROUP BY build)
SELECT build, NULL AS item, 'source' AS rule, source_sha AS value FROM b WHERE moved
UNION ALL SELECT build, NULL, 'version', version FROM b WHERE version = '1.0'
UNION ALL SELECT build, name, 'name', name FROM f WHERE starts_with(name, '../')
UNION ALL SELECT build, name, 'kind', 'zip' FROM f WHERE ends_with(name, '.zip')
UNION ALL SELECT build, name, 'size', CAST(size AS VARCHAR) FROM f WHERE size <> floor(size) OR size > 48
UNION ALL SELECT build, name, 'sha256', sha256 FROM f WHERE sha256 <> lower(sha256)
UNION ALL SELECT b.build, NULL, 'files', CAST(coalesce(n, 0) AS VARCHAR) FROM b LEFT JOIN g USING (build) WHERE NOT coalesce(ok, false)
""")
def build_violations(t: Tables) -> DataFrame:
    sha = F.left(digest(F.col("o_custkey").cast("string")), F.lit(40))
    builds = t.orders.select(
        F.col("o_orderkey").alias("build"), sha.alias("source_sha"),
        F.when(F.col("o_orderstatus") == "P", F.reverse(sha)).otherwise(sha).alias("expected_sha"),
        F.when(F.col("o_orderpriority") == "1-URGENT", "1.0").when(F.col("o_orderpriority") == "2-HIGH", "1.0.0-rc_1").otherwise("1.0.0").alias("version"),
    )
    line = F.col("l_linenumber")
    kind = F.when(line == 1, ".deb").when(line == 2, ".apk").when(line == 3, ".exe").otherwise(".zip")
    part = digest(F.col("l_partkey").cast("string"))
    files = t.lineitem.select(
        F.col("l_orderkey").alias("build"),
        F.concat(F.when(F.col("l_discount") > 0.09, "../").otherwise(""), F.lit("f"), line.cast("string"), kind).alias("name"),
        F.when(F.col("l_tax") > 0.07, F.col("l_quantity") + 0.5).otherwise(F.col("l_quantity")).alias("size"),
        F.when(F.col("l_linestatus") == "F", part).otherwise(F.upper(part)).alias("sha256"),
    )
    return build_check(builds, files, max_size=48)


@query("release_check", RELEASE_SQL)
def release_violations(t: Tables) -> DataFrame:
    return release_check(*release_inputs(t), max_size=48)


SCREEN_SQL = r"""
WITH s AS (
  SELECT doc_id AS index, concat('S-', CASE WHEN lang = 'es' THEN CAST(doc_id AS VARCHAR) ELSE lpad(CAST(doc_id AS VARCHAR), CAST(greatest(3, length(CAST(doc_id AS VARCHAR))) AS INT), '0') END) AS id,
    text, lang, source, n_chars, regexp_extract(text, '\A(.*?)(?:\r?\n|\z)', 1) AS title FROM documents
), n AS (SELECT count(*) AS n FROM documents)
SELECT id, 'index' AS rule, CAST(1 AS BIGINT) AS ordinal, CAST(index AS VARCHAR) AS value FROM s, n WHERE NOT index < n.n
UNION ALL SELECT id, 'id', 2, id FROM s WHERE id <> concat('S-', lpad(CAST(index AS VARCHAR), CAST(greatest(3, length(CAST(index AS VARCHAR))) AS INT), '0'))
UNION ALL SELECT id, 'description', 3, CAST(length(text) AS VARCHAR) FROM s WHERE length(text) < 200
UNION ALL SELECT id, 'title', 4, title FROM s WHERE title = ''
UNION ALL SELECT id, 'controls', 7, NULL FROM s WHERE n_chars < 150
UNION ALL SELECT id, 'confidence', 8, NULL FROM s WHERE lang = 'fr'
UNION ALL SELECT id, 'action', 9, NULL FROM s WHERE title = ''
"""


def screen_id() -> Column:
    number = F.when(F.col("lang") == "es", F.col("doc_id").cast("string")).otherwise(padded("doc_id", 3))
    return F.concat(F.lit("S-"), number)


def screens(t: Tables) -> DataFrame:
    docs = t.documents
    step = F.struct(
        (F.col("doc_id") + 1).cast("string").alias("to"),
        first_line("text").alias("action"),
        F.when(F.col("lang") == "fr", "seen").otherwise("inferred").alias("confidence"),
    )
    return docs.select(
        F.col("doc_id").alias("index"),
        screen_id().alias("id"),
        F.col("text").alias("description"),
        first_line("text").alias("title"),
        F.col("source").alias("summary"),
        F.col("lang").alias("category"),
        F.when(F.col("n_chars") >= 150, F.array("source")).alias("controls"),
        F.array(step).alias("transitions"),
    )


@query("screen_check", SCREEN_SQL)
def screen_violations(t: Tables) -> DataFrame:
    total = t.documents.agg(F.count(F.lit(1)).alias("n"))
    return screen_check(screens(t), total.scalar(), prefix="S-")


@query("evidence_problems", f"""
WITH d AS (SELECT *, CASE WHEN doc_id < 100 THEN lpad(CAST(doc_id AS VARCHAR), 3, '0') ELSE CAST(doc_id AS VARCHAR) END AS three FROM documents),
s AS (SELECT *, concat('S-', CASE WHEN lang = 'es' THEN CAST(doc_id AS VARCHAR) ELSE three END) AS id, CAST(doc_id + 1 AS VARCHAR) AS target FROM d),
m AS (SELECT id AS member FROM s WHERE lang IS DISTINCT FROM 'en' UNION ALL SELECT concat('S-', n_chars) FROM s)
SELECT 'count' AS problem, NULL AS item, count(*) AS n_rows FROM s
UNION ALL SELECT 'duplicate_id', id, count(*) FROM s GROUP BY id HAVING count(*) > 1
UNION ALL SELECT 'no_file', id, count(*) FROM s WHERE lang = 'fr' GROUP BY id
UNION ALL SELECT 'unknown_target', target, count(*) FROM s WHERE target NOT IN (SELECT id FROM s) GROUP BY target
UNION ALL SELECT 'unknown_member', member, count(*) FROM m WHERE member NOT IN (SELECT id FROM s) GROUP BY member
UNION ALL SELECT 'uncovered', id, count(*) FROM s WHERE id NOT IN (SELECT member FROM m) GROUP BY id
UNION ALL SELECT concat('rule_', rule), id, count(*) FROM ({SCREEN_SQL}) GROUP BY ALL
""")
def unsound_screens(t: Tables) -> DataFrame:
    """One screen more is expected than there is; French documents have no picture, English ones a single journey."""
    total = t.documents.agg((F.count(F.lit(1)) + 1).alias("n"))
    picture = F.when(F.col("lang").eqNullSafe("fr"), ".jpg").otherwise(".png")
    files = t.documents.select(F.concat(F.lit("screen "), F.col("doc_id").cast("string"), picture).alias("file"))
    second = F.concat(F.lit("S-"), F.col("n_chars").cast("string"))
    own = F.when(~F.col("lang").eqNullSafe("en"), screen_id())
    journeys = t.documents.select(F.col("doc_id").alias("position"), first_line("text").alias("title"),
                                  F.array_compact(F.array(own, second)).alias("nodes"))
    return evidence_problems(screens(t), journeys, files, "file", total.scalar(), prefix="S-")


JOB_SQL = """
WITH j AS (SELECT doc_id AS job, lang, source, n_chars // 50 AS minutes, left(sha256(text), 40) AS pin FROM documents)
SELECT job, CAST(NULL AS BIGINT) AS position, 'hosted_runner' AS rule, 'self-hosted' AS value FROM j WHERE lang = 'es'
UNION ALL SELECT job, NULL, 'timeout', CAST(minutes AS VARCHAR) FROM j WHERE NOT (minutes > 0 AND minutes <= 60)
UNION ALL SELECT job, CASE WHEN lang = 'fr' THEN 2 ELSE 1 END, 'pinned', 'actions/upload-artifact@v4' FROM j WHERE lang <> 'en'
UNION ALL SELECT job, CASE WHEN lang = 'fr' THEN 2 ELSE 1 END, 'artefact_required', concat('actions/upload-artifact@', CASE WHEN lang = 'en' THEN pin ELSE 'v4' END) FROM j WHERE minutes > 30
UNION ALL SELECT job, CASE WHEN lang = 'fr' THEN 2 ELSE 1 END, 'artefact_path', concat('actions/upload-artifact@', CASE WHEN lang = 'en' THEN pin ELSE 'v4' END) FROM j WHERE source = 'src1'
UNION ALL SELECT job, NULL, 'step_order', NULL FROM j WHERE lang = 'fr'
"""


@query("job_policy", JOB_SQL)
def job_violations(t: Tables) -> DataFrame:
    lang, minutes = F.col("lang"), F.floor(F.col("n_chars") / 50).cast("bigint")
    pin = F.left(digest("text"), F.lit(40))
    no_options = F.lit(None).cast("map<string,string>")

    def step(uses: Column, run: Column, options: Column) -> Column:
        return F.struct(uses.cast("string").alias("uses"), run.cast("string").alias("run"), options.alias("with"))

    checkout = step(F.concat(F.lit("actions/checkout@"), pin), F.lit(None), no_options)
    upload = step(
        F.concat(F.lit("actions/upload-artifact@"), F.when(lang == "en", pin).otherwise("v4")),
        F.lit(None),
        F.create_map(F.lit("if-no-files-found"), F.when(minutes > 30, "warn").otherwise("error"),
                     F.lit("path"), F.when(F.col("source") == "src1", "out/test-results").otherwise("out")),
    )
    test = step(F.lit(None), F.lit("task test"), no_options)
    jobs = t.documents.select(
        F.col("doc_id").alias("name"),
        F.when(lang == "es", "self-hosted").otherwise("ubuntu").alias("runs_on"),
        minutes.alias("timeout_minutes"),
        F.when(lang == "fr", F.array(test, checkout, upload)).otherwise(F.array(checkout, upload, test)).alias("steps"),
    )
    return job_policy(jobs, F.startswith(F.col("uses"), F.lit("actions/checkout@")), F.col("run") == "task test")


@query("step_order", """
SELECT conv_id, first_at, then_at, coalesce(first_at < then_at, false) AS ok FROM (
  SELECT conv_id, min(CASE WHEN role = 'user' THEN turn END) AS first_at,
         min(CASE WHEN role = 'assistant' AND length(text) > 300 THEN turn END) AS then_at FROM conversations GROUP BY conv_id)
""")
def turn_order(t: Tables) -> DataFrame:
    long_answer = (F.col("role") == "assistant") & (F.char_length("text") > 300)
    return step_order(t.conversations, "conv_id", "turn", F.col("role") == "user", long_answer)


DOCUMENT_SCHEMA = {
    "type": "object",
    "required": ["id", "origin", "size"],
    "additionalProperties": False,
    "properties": {
        "id": {"type": "integer", "minimum": 10},
        "origin": {
            "type": "object",
            "required": ["lang", "source"],
            "properties": {"lang": {"enum": ["en", "de"]}, "source": {"$ref": "#/definitions/source"}},
        },
        "size": {"type": "integer", "maximum": 1500},
        "words": {"type": "array", "maxItems": 200, "items": {"type": "string", "maxLength": 9}},
    },
    "definitions": {"source": {"type": "string", "pattern": r"\Asrc[0-9]\z"}},
}


@query("schema_violations", r"""
WITH d AS (SELECT *, string_split(text, ' ') AS words FROM documents), w AS (SELECT doc_id, unnest(words) AS word, generate_subscripts(words, 1) - 1 AS i FROM d)
SELECT doc_id, '$.id' AS path, 'minimum' AS keyword, CAST(doc_id AS VARCHAR) AS value FROM d WHERE doc_id < 10
UNION ALL SELECT doc_id, '$.origin.lang', 'enum', lang FROM d WHERE lang NOT IN ('en', 'de')
UNION ALL SELECT doc_id, '$.origin.lang', 'required', NULL FROM d WHERE lang IS NULL
UNION ALL SELECT doc_id, '$.origin.source', 'pattern', source FROM d WHERE NOT regexp_matches(source, '^src[0-9]$')
UNION ALL SELECT doc_id, '$.origin.source', 'required', NULL FROM d WHERE source IS NULL
UNION ALL SELECT doc_id, '$.size', 'maximum', CAST(n_chars AS VARCHAR) FROM d WHERE n_chars > 1500 AND lang IS DISTINCT FROM 'es'
UNION ALL SELECT doc_id, '$.size', 'type', CAST(n_chars AS VARCHAR) FROM d WHERE lang = 'es'
UNION ALL SELECT doc_id, '$.size', 'required', NULL FROM d WHERE n_chars IS NULL
UNION ALL SELECT doc_id, '$.note', 'additionalProperties', lang FROM d WHERE lang = 'fr'
UNION ALL SELECT doc_id, '$.words', 'maxItems', NULL FROM d WHERE len(words) > 200
UNION ALL SELECT doc_id, concat('$.words[', i, ']'), 'maxLength', word FROM w WHERE length(word) > 9
""")
def nested_shape_violations(t: Tables) -> DataFrame:
    """Documents as nested JSON: in Spanish ones the size is a string, French ones have a field more."""
    common = [F.col("doc_id").alias("id"), F.struct("lang", "source").alias("origin"), F.split("text", " ").alias("words")]
    size = F.col("n_chars")
    body = (
        F.when(F.col("lang") == "es", F.to_json(F.struct(*common, size.cast("string").alias("size"))))
        .when(F.col("lang") == "fr", F.to_json(F.struct(*common, size.alias("size"), F.col("lang").alias("note"))))
        .otherwise(F.to_json(F.struct(*common, size.alias("size"))))
    )
    found = schema_violations(t.documents.select("doc_id", body.alias("body")), "body", DOCUMENT_SCHEMA, ["doc_id"])
    # The value of a list that is too long is the whole list.
    return found.withColumn("value", F.when(F.col("keyword") != "maxItems", F.col("value")))


@query("conform", """
WITH e AS (SELECT event_id, CASE event_type WHEN 'error' THEN left(props, length(props) - 1)
      WHEN 'click' THEN replace(props, '}', ', "x": 1}') WHEN 'view' THEN replace(props, '"k"', '"j"')
      WHEN 'signup' THEN regexp_replace(props, '([0-9]+)', '"\\1"') ELSE props END AS body, event_type,
      regexp_extract(props, '[0-9]+') AS k FROM events)
SELECT event_id, 'object' AS rule, CAST(1 AS BIGINT) AS ordinal, body AS value FROM e WHERE event_type = 'error'
UNION ALL SELECT event_id, 'required:k', 2, NULL FROM e WHERE event_type = 'view'
UNION ALL SELECT event_id, 'additional', 3, CASE event_type WHEN 'click' THEN 'x' ELSE 'j' END FROM e WHERE event_type IN ('click', 'view')
UNION ALL SELECT event_id, 'type:k', 4, 'STRING' FROM e WHERE event_type = 'signup'
UNION ALL SELECT event_id, 'length:k', 5, '2' FROM e WHERE event_type NOT IN ('error', 'view') AND length(k) > 1
UNION ALL SELECT event_id, 'format:k', 6, k FROM e WHERE event_type NOT IN ('error', 'view') AND k = '0'
""")
def shape_violations(t: Tables) -> DataFrame:
    kind, props = F.col("event_type"), F.col("props")
    body = (
        F.when(kind == "error", F.left(props, F.length(props) - 1))
        .when(kind == "click", F.replace(props, F.lit("}"), F.lit(', "x": 1}')))
        .when(kind == "view", F.replace(props, F.lit('"k"'), F.lit('"j"')))
        .when(kind == "signup", F.regexp_replace(props, "([0-9]+)", '"$1"'))
        .otherwise(props)
    )
    rows = t.events.select("event_id", body.alias("body"))
    return conform(rows, "body", ["event_id"], required=["k"], allowed=["k"], max_length={"k": 1}, formats={"k": "port"},
                   types={"k": "number"})


@query("deploy_check", """
SELECT doc_id, CASE WHEN source = 'src3' THEN 'repository' WHEN lang = 'es' THEN 'commit' WHEN n_chars < 300 THEN 'backend'
   WHEN lang = 'de' THEN 'platform' WHEN trim(text, ' ') <> text OR contains(text, chr(10)) THEN 'sha256' END AS problem,
   NOT (source = 'src3' OR lang = 'es' OR n_chars < 300 OR lang = 'de' OR trim(text, ' ') <> text OR contains(text, chr(10))) AS deployable
FROM documents
""")
def deployable(t: Tables) -> DataFrame:
    sha = F.left(digest(F.col("doc_id").cast("string")), F.lit(40))
    one_line = F.btrim(F.replace("text", F.lit("\n"), F.lit(" ")))
    rows = t.documents.select(
        "doc_id",
        F.when(F.col("source") == "src3", "fork/app").otherwise("team/app").alias("repository"),
        F.when(F.col("lang") == "es", F.reverse(sha)).otherwise(sha).alias("commit"),
        F.when(F.col("n_chars") < 300, F.reverse(sha)).otherwise(sha).alias("backend"),
        F.when(F.col("lang") == "de", "linux-arm64").otherwise("linux-amd64").alias("platform"),
        digest(one_line).alias("sha256"),
        sha.alias("expected_commit"),
        sha.alias("expected_backend"),
        digest("text").alias("content_sha256"),
    )
    return deploy_check(rows, "team/app").select("doc_id", "problem", "deployable")


@query("group_rules", """
SELECT l_orderkey, count(*) AS n_rows, count(DISTINCT l_returnflag) AS n_kinds,
       bool_and(l_quantity > 0 AND l_quantity <= 48) AS sizes_ok, count(*) = 3 AS count_ok,
       count(DISTINCT l_returnflag) = count(*) AS kinds_ok,
       count(*) = 3 AND count(DISTINCT l_returnflag) = count(*) AND bool_and(l_quantity > 0 AND l_quantity <= 48) AS ok
FROM lineitem GROUP BY l_orderkey
""")
def manifest_groups(t: Tables) -> DataFrame:
    return group_rules(t.lineitem, ["l_orderkey"], kind="l_returnflag", size="l_quantity",
                       expected_kinds=["A", "N", "R"], max_size=48)


@query("group_verdict", """
SELECT l_suppkey, count(*) >= 10 AS enough, count(DISTINCT l_returnflag) = 3 AS every_flag, max(l_discount) < 0.1 AS modest,
       count(*) >= 10 AND count(DISTINCT l_returnflag) = 3 AND max(l_discount) < 0.1 AS ok FROM lineitem GROUP BY l_suppkey
""")
def supplier_verdicts(t: Tables) -> DataFrame:
    return group_verdict(t.lineitem, ["l_suppkey"], {
        "enough": F.count(F.lit(1)) >= 10,
        "every_flag": F.countDistinct("l_returnflag") == 3,
        "modest": F.max("l_discount") < 0.1,
    })


@query("duplicates", """
SELECT l_orderkey, l_linenumber, count(*) AS n_rows FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1
""")
def repeated_lines(t: Tables) -> DataFrame:
    return duplicates(t.lineitem, ["l_orderkey"], ["l_linenumber"])


@query("completeness", """
SELECT count(*) AS n_rows, count(DISTINCT l_orderkey) AS n_keys, count(*) = (SELECT count(*) FROM orders)
   AND count(DISTINCT l_orderkey) = (SELECT count(*) FROM orders) AS complete FROM lineitem
""")
def complete(t: Tables) -> DataFrame:
    expected = t.orders.agg(F.count(F.lit(1))).scalar()
    return completeness(t.lineitem, "l_orderkey", expected)


@query("report_gate", """
WITH r AS (SELECT user_id, strftime(ts, '%Y-%m-%d') AS day, CASE event_type WHEN 'purchase' THEN 'expected' WHEN 'signup' THEN 'expected'
   WHEN 'view' THEN CASE WHEN value > 40 THEN 'unexpected' ELSE 'expected' END
   WHEN 'click' THEN CASE WHEN value > 30 THEN 'skipped' WHEN value > 25 THEN 'flaky' ELSE 'expected' END ELSE 'error' END AS outcome FROM events)
SELECT user_id, day, count(*) FILTER (outcome = 'expected') AS expected, count(*) FILTER (outcome = 'unexpected') AS unexpected,
  count(*) FILTER (outcome = 'skipped') AS skipped, count(*) FILTER (outcome = 'flaky') AS flaky, count(*) FILTER (outcome = 'error') AS errors,
  count(*) FILTER (outcome = 'expected') > 0 AND count(*) FILTER (outcome <> 'expected') = 0 AS passed
FROM r GROUP BY user_id, day
""")
def gates(t: Tables) -> DataFrame:
    kind, value = F.col("event_type"), F.col("value")
    outcome = (
        F.when(kind.isin("purchase", "signup"), "expected")
        .when(kind == "view", F.when(value > 40, "unexpected").otherwise("expected"))
        .when(kind == "click", F.when(value > 30, "skipped").when(value > 25, "flaky").otherwise("expected"))
        .otherwise("error")
    )
    rows = t.events.select("user_id", F.date_format("ts", "yyyy-MM-dd").alias("day"), outcome.alias("outcome"))
    return report_gate(rows, ["user_id", "day"], "outcome")


@query("readiness", """
SELECT user_id, day, count(*) AS n_checks, coalesce(string_agg(CASE WHEN NOT ok THEN event_type END, ',' ORDER BY event_type), '') AS failures, bool_and(ok) AS ready
FROM (SELECT user_id, strftime(ts, '%Y-%m-%d') AS day, event_type, bool_and(value < 15) AS ok FROM events GROUP BY ALL) GROUP BY user_id, day
""")
def ready(t: Tables) -> DataFrame:
    rows = t.events.withColumn("day", F.date_format("ts", "yyyy-MM-dd"))
    result = readiness(rows, ["user_id", "day"], "event_type", F.col("value") < 15,
                       ["click", "error", "purchase", "signup", "view"])
    return result.withColumn("failures", F.array_join("failures", ","))


@query("content_drift", r"""
SELECT title, count(DISTINCT sha256(text)) AS n_digests FROM (SELECT regexp_extract(text, '\A(.*?)(?:\r?\n|\z)', 1) AS title, text FROM documents)
GROUP BY title HAVING count(DISTINCT sha256(text)) > 1
""")
def drift(t: Tables) -> DataFrame:
    rows = t.documents.select(first_line("text").alias("title"), digest("text").alias("sha256"))
    return content_drift(rows, ["title"], "sha256")


@query("combine", """
SELECT source_table, count(*) AS n_rows, count(DISTINCT id) AS n_ids FROM (
  SELECT 'events' AS source_table, event_id AS id FROM events UNION ALL SELECT 'orders', o_orderkey FROM orders
  UNION ALL SELECT 'documents', doc_id FROM documents) GROUP BY source_table
""")
def combined(t: Tables) -> DataFrame:
    batches = [
        t.events.select(F.lit("events").alias("source_table"), F.col("event_id").alias("id")),
        t.orders.select(F.lit("orders").alias("source_table"), F.col("o_orderkey").alias("id")),
        t.documents.select(F.lit("documents").alias("source_table"), F.col("doc_id").alias("id")),
    ]
    return combine(*batches).groupBy("source_table").agg(
        F.count(F.lit(1)).alias("n_rows"), F.countDistinct("id").alias("n_ids")
    )


@query("in_order", """
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice,
  row_number() OVER (ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS position FROM lineitem
""")
def numbered_lines(t: Tables) -> DataFrame:
    columns = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"]
    return in_order(t.lineitem.select(*columns), columns)


@query("same_rows", """
WITH b AS (SELECT p_partkey, p_name, p_brand, p_type, greatest(p_size, 3) AS p_size FROM part),
     a AS (SELECT p_partkey, p_name, p_brand, p_type, p_size FROM part)
SELECT x AS only_left, y AS only_right, x = 0 AND y = 0 AS equal
FROM (SELECT (SELECT count(*) FROM (SELECT * FROM a EXCEPT ALL SELECT * FROM b)) AS x, (SELECT count(*) FROM (SELECT * FROM b EXCEPT ALL SELECT * FROM a)) AS y)
""")
def equal_tables(t: Tables) -> DataFrame:
    a = t.part.select("p_partkey", "p_name", "p_brand", "p_type", "p_size")
    return change_counts(a, a.withColumn("p_size", F.greatest("p_size", F.lit(3))))


@query("same_rows_by_range", """
WITH a AS (SELECT o_orderkey, o_custkey FROM orders),
     b AS (SELECT o_orderkey, CASE WHEN o_totalprice < 2000 THEN o_custkey + 1 ELSE o_custkey END AS o_custkey FROM orders),
     x AS (SELECT o_orderkey, o_custkey, 1 AS d FROM a UNION ALL SELECT o_orderkey, o_custkey, -1 FROM b)
SELECT o_orderkey, o_custkey, CAST(sum(d) AS BIGINT) AS surplus FROM x GROUP BY o_orderkey, o_custkey HAVING sum(d) <> 0
""")
def orders_read_back(t: Tables) -> DataFrame:
    changed = F.when(F.col("o_totalprice") < 2000, F.col("o_custkey") + 1).otherwise(F.col("o_custkey"))
    return same_rows_by_range(t.orders.select("o_orderkey", "o_custkey"), t.orders.select("o_orderkey", changed.alias("o_custkey")), "o_orderkey")


@query("parse_records", """
WITH e AS (SELECT event_id, CAST(regexp_extract(props, '[0-9]+') AS BIGINT) AS k, event_type,
   CASE event_type WHEN 'view' THEN concat('[', props, ', ', props, ']') WHEN 'error' THEN left(props, length(props) - 1)
        WHEN 'click' THEN concat(props, repeat(' ', CAST(value AS INT))) ELSE props END AS body FROM events)
SELECT event_id, k, NULL AS problem FROM e WHERE event_type <> 'error' AND length(body) <= 40
UNION ALL SELECT event_id, k, NULL FROM e WHERE event_type = 'view' AND length(body) <= 40
UNION ALL SELECT event_id, NULL, CASE WHEN length(body) > 40 THEN 'too_large' ELSE 'bad_json' END FROM e WHERE event_type = 'error' OR length(body) > 40
""")
def records(t: Tables) -> DataFrame:
    kind, props = F.col("event_type"), F.col("props")
    body = (
        F.when(kind == "view", F.concat(F.lit("["), props, F.lit(", "), props, F.lit("]")))
        .when(kind == "error", F.left(props, F.length(props) - 1))
        .when(kind == "click", F.concat(props, F.repeat(F.lit(" "), F.bround(F.col("value")).cast("int"))))
        .otherwise(props)
    )
    rows = t.events.select("event_id", body.alias("body"))
    schema = T.StructType([T.StructField("k", T.LongType())])
    accepted, refused = parse_records(rows, "body", schema, max_bytes=40)
    return combine(accepted.select("event_id", "k"), refused.select("event_id", "problem")).select(
        "event_id", "k", "problem"
    )
