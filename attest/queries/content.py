"""Digests, upload planning, reconciliation."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attest.functions.content import byte_length, digest
from attest.functions.text import first_line
from attest.operators.digests import checksum_listing, concat_corpus, listing_digest, plan_uploads, undecided, verify_digests
from attest.operators.reconcile import (
    changed_only,
    current_options,
    lookup_context,
    match_pins,
    option_drift,
    reconcile_links,
    verify_targets,
)
from attest.operators.sets import outcome_summary
from attest.plans.release import checked_publication, publication_plan
from attest.queries.registry import Tables, query
from attest.session import written
from attest.sources.records import content_table


def stored_documents(t: Tables) -> DataFrame:
    """Labelled documents as another store holds them: some reflowed, some lower-cased."""
    return t.labels.join(t.documents, "doc_id").withColumn(
        "stored",
        F.when(F.col("toxic") == 1, F.replace("text", F.lit("\n"), F.lit(" \n")))
        .when(F.col("quality") == 0, F.lower("text"))
        .otherwise(F.col("text")),
    )


STORED = """
WITH s AS (SELECT doc_id, CASE WHEN toxic = 1 THEN replace(text, chr(10), ' ' || chr(10)) WHEN quality = 0 THEN lower(text) ELSE text END AS stored,
                  text, quality, toxic FROM labels JOIN documents USING (doc_id))
"""


@query("verify_digests", STORED + """
SELECT d.doc_id, sha256(d.text) AS sha256, sha256(s.stored) AS actual_sha256,
  CASE WHEN s.doc_id IS NULL THEN 'missing' WHEN octet_length(encode(d.text)) <> octet_length(encode(s.stored)) THEN 'size_mismatch'
       WHEN sha256(d.text) <> sha256(s.stored) THEN 'digest_mismatch' ELSE 'match' END AS verdict
FROM documents d LEFT JOIN s USING (doc_id)
""")
def verified(t: Tables) -> DataFrame:
    expected = t.documents.select("doc_id", byte_length("text").alias("size"), digest("text").alias("sha256"))
    actual = stored_documents(t).select("doc_id", byte_length("stored").alias("size"), digest("stored").alias("sha256"))
    return verify_digests(expected, actual, ["doc_id"]).select("doc_id", "sha256", "actual_sha256", "verdict")


def upload_sides(t: Tables) -> tuple[DataFrame, DataFrame]:
    local = t.documents.select("doc_id", "source", digest("text").alias("sha256"))
    declared = F.when(F.col("quality") == 1, digest("text")).when(F.col("toxic") == 1, digest("stored"))
    remote = stored_documents(t).select(
        "doc_id", declared.alias("declared_sha256"), digest("stored").alias("computed_sha256")
    )
    return local, remote


UPLOADS = STORED + """, r AS (
  SELECT doc_id, CASE WHEN quality = 1 THEN sha256(text) WHEN toxic = 1 THEN sha256(stored) END AS declared, sha256(stored) AS computed FROM s),
u AS (SELECT d.doc_id, d.source, sha256(d.text) AS sha256,
    CASE WHEN r.doc_id IS NULL THEN 'upload' WHEN declared = sha256(d.text) OR computed = sha256(d.text) THEN 'skip' ELSE 'conflict' END AS action
  FROM documents d LEFT JOIN r USING (doc_id))
"""


@query("plan_uploads", UPLOADS + "SELECT doc_id, source, sha256, action FROM u")
def uploads(t: Tables) -> DataFrame:
    return plan_uploads(*upload_sides(t), ["doc_id"]).select("doc_id", "source", "sha256", "action")


@query("undecided", STORED + """
SELECT doc_id FROM s WHERE coalesce(CASE WHEN quality = 1 THEN sha256(text) WHEN toxic = 1 THEN sha256(stored) END <> sha256(text), true)
""")
def content_to_read(t: Tables) -> DataFrame:
    local, remote = upload_sides(t)
    return undecided(local, remote.select("doc_id", "declared_sha256"), ["doc_id"]).select("doc_id")


@query("outcome_summary", UPLOADS + """
SELECT source, count(*) AS n_rows, count(*) FILTER (action = 'upload') AS n_upload, count(*) FILTER (action = 'skip') AS n_skip,
       count(*) FILTER (action = 'conflict') AS n_conflict FROM u GROUP BY source
""")
def outcomes(t: Tables) -> DataFrame:
    planned = plan_uploads(*upload_sides(t), ["doc_id"])
    return outcome_summary(planned, ["source"], "action", ["upload", "skip", "conflict"])


@query("checksum_listing", """
SELECT source, (pos - 1) // 20 AS block, count(*) AS n_lines,
  sha256(string_agg(sha256(text) || '  ' || doc_id || chr(10), '' ORDER BY pos)) AS listing_sha256
FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS pos FROM documents) GROUP BY source, block
""")
def listings(t: Tables) -> DataFrame:
    rows = t.documents.select("source", "doc_id", digest("text").alias("sha256"))
    return checksum_listing(rows, ["source"], ["doc_id"], "doc_id", "sha256", block_lines=20).drop("text")


@query("listing_digest", """
SELECT source, count(*) AS n_lines, sha256(string_agg(sha256(text) || '  ' || doc_id || chr(10), '' ORDER BY doc_id)) AS listing_sha256 FROM documents GROUP BY source
""")
def whole_listings(t: Tables) -> DataFrame:
    rows = t.documents.select("source", "doc_id", digest("text").alias("sha256"))
    return listing_digest(rows, ["source"], ["doc_id"], "doc_id", "sha256")


@query("concat_corpus", r"""
WITH p AS (SELECT source, doc_id, concat('# ', regexp_extract(text, '\A(.*?)(?:\r?\n|\z)', 1), ' (/', lang, '/', doc_id, ')', chr(10), chr(10), text) AS page FROM documents),
b AS (SELECT *, (sum(octet_length(encode(page))) OVER (PARTITION BY source ORDER BY doc_id) - octet_length(encode(page))) // 20000 AS block FROM p)
SELECT source, CAST(block AS BIGINT) AS block, count(*) AS n_lines, string_agg(page, chr(10) || chr(10) ORDER BY doc_id) AS text FROM b GROUP BY source, block
""")
def corpus(t: Tables) -> DataFrame:
    url = F.concat(F.lit("/"), "lang", F.lit("/"), F.col("doc_id").cast("string"))
    return concat_corpus(t.documents, ["source"], ["doc_id"], first_line("text"), url, "text", block_bytes=20_000)


LINKS_SQL = """
WITH d AS (SELECT l_orderkey AS grp, l_linenumber AS name, min(l_partkey) AS url, arg_min(l_suppkey, l_partkey * 1000000 + l_suppkey) AS path FROM lineitem GROUP BY ALL),
x AS (SELECT l_orderkey AS grp, l_linenumber AS name, l_partkey AS url, l_suppkey + CASE WHEN l_linestatus = 'F' THEN 0 ELSE 1 END AS path,
        CASE WHEN l_suppkey < 20 THEN NULL ELSE l_partkey END AS id,
        l_partkey * 10000000 + l_suppkey * 2 + CASE WHEN l_linestatus = 'F' THEN 0 ELSE 1 END AS position FROM lineitem WHERE l_returnflag <> 'N' AND l_tax < 0.06),
f AS (SELECT grp, name, min(position) AS position FROM x GROUP BY ALL),
o AS (SELECT DISTINCT x.grp, x.name, x.url, x.path, x.id FROM x JOIN f USING (grp, name, position)),
c AS (SELECT d.*, o.url AS ourl, o.path AS opath, o.id AS oid, o.grp IS NOT NULL AS matched FROM d LEFT JOIN o USING (grp, name)),
g AS (SELECT grp, bool_or(coalesce(ourl <> url, false)) AS conflict FROM c GROUP BY grp)
SELECT c.grp, c.name, c.url, c.path, oid AS existing_id,
  CASE WHEN c.grp NOT IN (SELECT grp FROM x) THEN 'create' WHEN g.conflict THEN 'conflict' WHEN NOT matched THEN 'add'
       WHEN opath = path THEN 'keep' WHEN oid IS NULL THEN 'error' ELSE 'update_path' END AS action
FROM c JOIN g USING (grp)
"""


@query("reconcile_links", LINKS_SQL)
def links(t: Tables) -> DataFrame:
    part, supp = F.col("l_partkey"), F.col("l_suppkey")
    names = [F.col("l_orderkey").alias("grp"), F.col("l_linenumber").alias("name")]
    desired = t.lineitem.groupBy(*names).agg(
        F.min(part).alias("url"), F.min_by(supp, part * 1000000 + supp).alias("path")
    )
    shifted = F.when(F.col("l_linestatus") == "F", 0).otherwise(1)
    # What is not there yet belongs to groups that nobody wants.
    there = (F.col("l_returnflag") != "N") & (F.col("l_tax") < 0.06)
    existing = t.lineitem.select(
        F.when(there, F.col("l_orderkey")).otherwise(-F.col("l_orderkey") - 1).alias("grp"),
        names[1],
        part.alias("url"),
        (supp + shifted).alias("path"),
        F.when(supp >= 20, part).alias("id"),
        (part * 10000000 + supp * 2 + shifted).alias("position"),
    )
    return reconcile_links(desired, existing, "grp", "name", "position")


TARGETS = """
WITH tags AS (SELECT o_orderkey AS name, CASE WHEN o_orderstatus = 'F' THEN o_custkey END AS commit_id, o_custkey + CASE WHEN o_totalprice > 200000 THEN 1 ELSE 0 END AS target
              FROM orders WHERE o_orderpriority <> '5-LOW'),
     commits AS (SELECT c_custkey AS id FROM customer WHERE c_acctbal >= 0)
"""


@query("verify_targets", TARGETS + """
SELECT o_orderkey AS release, o_custkey AS ref, coalesce(commit_id, target) AS tag_target,
  CASE WHEN id IS NULL THEN 'missing_commit' WHEN name IS NULL THEN 'new_tag' WHEN coalesce(commit_id, target) <> o_custkey THEN 'tag_moved' ELSE 'tag_matches' END AS verdict
FROM orders LEFT JOIN commits ON id = o_custkey LEFT JOIN tags ON name = o_orderkey
""")
def targets(t: Tables) -> DataFrame:
    releases, commits, tags = target_tables(t)
    result = verify_targets(releases, commits, tags)
    return result.select("release", F.col("ref").cast("bigint").alias("ref"),
                         F.col("tag_target").cast("bigint").alias("tag_target"), "verdict")


def target_tables(t: Tables) -> tuple[DataFrame, DataFrame, DataFrame]:
    ref = F.col("o_custkey").cast("string")
    tag = F.col("o_orderkey").cast("string")
    releases = t.orders.select(F.col("o_orderkey").alias("release"), ref.alias("ref"), tag.alias("tag"))
    # A commit or tag that is not there has a name that no release refers to.
    there = F.when(F.col("c_acctbal") >= 0, "").otherwise("-")
    commits = t.customer.select(F.concat(there, F.col("c_custkey").cast("string")).alias("id"))
    moved = F.col("o_custkey") + F.when(F.col("o_totalprice") > 200000, 1).otherwise(0)
    tags = t.orders.select(
        F.concat(F.when(F.col("o_orderpriority") == "5-LOW", "-").otherwise(""), tag).alias("name"),
        F.when(F.col("o_orderstatus") == "F", ref).alias("commit_id"),
        moved.cast("string").alias("target"),
    )
    return releases, commits, tags


@query("match_pins", """
WITH b AS (SELECT o_orderkey, o_custkey AS component, CASE WHEN o_orderstatus = 'P' THEN 'other' ELSE sha256(CAST(o_custkey AS VARCHAR)) END AS source_sha,
   CASE WHEN starts_with(o_orderpriority, '1') THEN '2.0.0' ELSE '1.0.0' END AS version,
   concat('1.0.0', CASE WHEN starts_with(o_orderpriority, '2') THEN '-rc.1' WHEN starts_with(o_orderpriority, '3') THEN '.1' ELSE '' END) AS release_version FROM orders)
SELECT o_orderkey, CASE WHEN c_custkey IS NULL THEN 'unpinned' WHEN source_sha <> sha256(CAST(c_custkey AS VARCHAR)) THEN 'source'
   WHEN version <> '1.0.0' THEN 'version' WHEN NOT (release_version = '1.0.0' OR starts_with(release_version, '1.0.0-')) THEN 'release_version' ELSE 'ok' END AS verdict
FROM b LEFT JOIN (SELECT c_custkey FROM customer WHERE c_acctbal >= 0) ON c_custkey = component
""")
def pins(t: Tables) -> DataFrame:
    sha = digest(F.col("o_custkey").cast("string"))
    priority = F.col("o_orderpriority")
    builds = t.orders.select(
        "o_orderkey",
        F.col("o_custkey").alias("component"),
        F.when(F.col("o_orderstatus") == "P", "other").otherwise(sha).alias("source_sha"),
        F.when(priority.startswith("1"), "2.0.0").otherwise("1.0.0").alias("version"),
        F.concat(F.lit("1.0.0"),
                 F.when(priority.startswith("2"), "-rc.1").when(priority.startswith("3"), ".1").otherwise("")
                 ).alias("release_version"),
    )
    key = F.col("c_custkey")
    pinned = t.customer.select(
        F.when(F.col("c_acctbal") >= 0, key).otherwise(-key - 1).alias("component"), digest(F.col("c_custkey").cast("string")).alias("pinned_sha"),
        F.lit("1.0.0").alias("pinned_version"),
    )
    return match_pins(builds, pinned, ["component"]).select("o_orderkey", "verdict")


@query("lookup_context", """
SELECT event_id, CASE event_type WHEN 'view' THEN 'checks/view' WHEN 'click' THEN 'checks/click' WHEN 'signup' THEN 'checks/signup' WHEN 'purchase' THEN 'checks/shop' END AS context,
       event_type = 'error' AS unknown_name FROM events
""")
def contexts(t: Tables) -> DataFrame:
    mapping = {"view": "checks/view", "click": "checks/click", "signup": "checks/signup", "purchase": "checks/shop"}
    return lookup_context(t.events, "event_type", mapping).select("event_id", "context", "unknown_name")


@query("option_drift", """
WITH c AS (SELECT user_id AS key, arg_max(event_type, event_id) AS value FROM events GROUP BY user_id),
     w AS (SELECT c_custkey AS key, CASE WHEN c_acctbal < 3000 THEN 'view' WHEN c_acctbal < 6000 THEN 'click' ELSE 'purchase' END AS value FROM customer)
SELECT w.key, c.value AS current_value, w.value AS target_value FROM w LEFT JOIN c USING (key) WHERE c.value IS DISTINCT FROM w.value
""")
def drifted_options(t: Tables) -> DataFrame:
    current = current_options(t.events.withColumnRenamed("user_id", "key"), "key", "event_type", "event_id")
    balance = F.col("c_acctbal")
    wanted = F.when(balance < 3000, "view").when(balance < 6000, "click").otherwise("purchase")
    target = t.customer.select(F.col("c_custkey").alias("key"), wanted.alias("value"))
    return option_drift(current, target, "key").select("key", "current_value", "target_value")


@query("changed_only", """
SELECT event_id, user_id, event_type FROM (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS prev FROM events)
WHERE prev IS NULL OR prev <> event_type
""")
def changes(t: Tables) -> DataFrame:
    rows = t.events.select("event_id", "user_id", "event_type", "ts")
    return changed_only(rows, ["user_id"], ["ts", "event_id"], ["event_type"]).drop("ts")


PUBLICATION_SQL = TARGETS + """,
sound AS (SELECT o_orderkey AS release FROM orders JOIN commits ON id = o_custkey LEFT JOIN tags ON name = o_orderkey
          WHERE name IS NULL OR coalesce(commit_id, target) = o_custkey),
files AS (SELECT l_orderkey AS release, l_linenumber AS name, sha256(CAST(min(l_partkey) AS VARCHAR)) AS sha FROM lineitem GROUP BY ALL),
remote AS (SELECT l_orderkey AS release, l_linenumber AS name, sha256(CAST(max(l_partkey) AS VARCHAR)) AS computed FROM lineitem WHERE l_linestatus = 'F' GROUP BY ALL),
up AS (SELECT f.release, f.name, CASE WHEN r.release IS NULL THEN 'upload' WHEN computed = sha THEN 'skip' ELSE 'conflict' END AS action
       FROM files f SEMI JOIN sound USING (release) LEFT JOIN remote r ON r.release = f.release AND r.name = f.name)
SELECT release, name, CASE WHEN release IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R') THEN 'other' ELSE 'create' END AS action
FROM up WHERE release NOT IN (SELECT release FROM up WHERE action = 'conflict')
"""


@query("publication_plan", PUBLICATION_SQL)
def publication(t: Tables) -> DataFrame:
    releases, commits, tags = target_tables(t)
    names = [F.col("l_orderkey").alias("release"), F.col("l_linenumber").alias("name")]
    files = t.lineitem.groupBy(*names).agg(digest(F.min("l_partkey").cast("string")).alias("sha256"))
    order = F.col("l_orderkey")
    remote = (
        t.lineitem.groupBy(F.when(F.col("l_linestatus") == "F", order).otherwise(-order - 1).alias("release"), names[1])
        .agg(digest(F.max("l_partkey").cast("string")).alias("computed_sha256"))
        .withColumn("declared_sha256", F.lit(None).cast("string"))
    )
    existing = t.lineitem.select(
        F.when(F.col("l_returnflag") == "R", order).otherwise(-order - 1).alias("release"), names[1], F.lit("elsewhere").alias("url"), F.lit("/").alias("path"), F.col("l_partkey").alias("id"),
        F.col("l_partkey").alias("position"),
    )
    plan = publication_plan(releases, commits, tags, files, remote, existing, "https://files.example.com/")
    action = F.when(F.col("action") == "create", "create").otherwise("other")
    return plan["links"].select("release", "name", action.alias("action"))


# Orders are releases and their lines files. Lines 1 to 3 have links already: as they should be, with another path, and
# with another path and no id; of every eleventh order line 1 is linked elsewhere, every seventh has no links.
@query("checked_publication", """
WITH f AS (SELECT l_orderkey AS release, l_linenumber AS n, min(l_partkey) AS p, max(l_partkey) AS q, max(l_quantity) AS size, bool_or(l_linestatus = 'F') AS there
           FROM lineitem GROUP BY ALL),
r AS (SELECT o_orderkey AS release FROM orders JOIN customer ON c_custkey = o_custkey
      WHERE o_orderstatus <> 'P' AND c_acctbal >= 0 AND NOT (o_orderpriority = '1-URGENT' AND o_totalprice > 200000)
        AND o_orderkey NOT IN (SELECT release FROM f WHERE size > 49 OR (there AND p <> q))),
g AS (SELECT release, release % 7 <> 0 AND bool_or(n <= 3) AS known, release % 11 = 0 AND bool_or(n = 1) AS clash FROM f GROUP BY release)
SELECT release, concat(n, '.deb') AS name, CASE WHEN NOT known THEN 'create' WHEN clash THEN 'conflict' WHEN n > 3 THEN 'add'
  WHEN n = 1 THEN 'keep' WHEN n = 2 THEN 'update_path' ELSE 'error' END AS action
FROM f JOIN r USING (release) JOIN g USING (release)
""")
def published(t: Tables) -> DataFrame:
    prefix = "https://files.example.com/"
    ref = F.left(digest(F.concat(F.lit("c"), F.col("o_custkey").cast("string"))), F.lit(40))
    version = F.concat(F.lit("1."), F.col("o_orderkey").cast("string"), F.lit(".0"), F.when(F.col("o_orderstatus") == "P", "-rc_1").otherwise(""))
    manifests = t.orders.select(
        F.col("o_orderkey").alias("release"), version.alias("version"), F.concat(F.lit("v"), version).alias("tag"),
        ref.alias("ref"), ref.alias("client_sha"))
    away = F.when(F.col("c_acctbal") >= 0, "").otherwise("-")
    commit = F.left(digest(F.concat(F.lit("c"), F.col("c_custkey").cast("string"))), F.lit(40))
    commits = t.customer.select(F.concat(away, commit).alias("id"))
    tags = t.orders.select(
        F.concat(F.when(F.col("o_orderpriority") == "1-URGENT", "v").otherwise("-"), version).alias("name"),
        F.lit(None).cast("string").alias("commit_id"),
        F.when(F.col("o_totalprice") > 200000, "moved").otherwise(ref).alias("target"))
    # Files, what is there, remote files and links are all made of the same lines, so these are gathered once.
    lines = written(t.lineitem.groupBy(F.col("l_orderkey").alias("release"), F.col("l_linenumber").alias("n")).agg(
        F.min("l_partkey").alias("first"), F.max("l_partkey").alias("last"),
        F.max("l_quantity").alias("quantity"), F.bool_or(F.col("l_linestatus") == "F").alias("there")), "lines", "zstd", remove_shuffles=True)
    lines = lines.withColumns({"sha256": digest(F.col("first").cast("string")), "computed_sha256": digest(F.col("last").cast("string"))})
    lines = lines.withColumn("name", F.concat(F.col("n").cast("string"), F.lit(".deb")))
    lines = lines.withColumn("path", F.concat_ws("/", F.col("release").cast("string"), "name"))
    # What is not there has a name that no release refers to.
    actual = lines.select(F.concat(F.when(F.col("quantity") > 49, "-").otherwise(""), "path").alias("path"), "sha256", F.lit(1).cast("bigint").alias("size"))
    remote = lines.select(
        F.when(F.col("there"), F.col("release")).otherwise(-F.col("release") - 1).alias("release"), "name",
        F.lit(None).cast("string").alias("declared_sha256"), "computed_sha256")
    linked = (F.col("n") <= 3) & (F.col("release") % 7 != 0)
    elsewhere = (F.col("n") == 1) & (F.col("release") % 11 == 0)
    links = lines.select(
        F.when(linked, F.col("release")).otherwise(-F.col("release") - 1).alias("release"), "name",
        F.when(elsewhere, "elsewhere").otherwise(F.concat(F.lit(prefix), "path")).alias("url"),
        F.when(F.col("n") == 1, F.concat(F.lit("/"), "name")).otherwise("/old").alias("path"),
        F.when(F.col("n") != 3, F.col("n")).alias("id"), F.col("n").alias("position"))
    plan = checked_publication(manifests, lines.select("release", "path", "name", "sha256"), actual, commits, tags, remote, links, prefix)
    return plan["links"].select("release", "name", "action")


@query("content_table", """
SELECT doc_id, CAST(octet_length(encode(text)) AS BIGINT) AS length, CASE WHEN octet_length(encode(text)) <= 4000 THEN sha256(text) END AS sha256 FROM documents
""")
def contents(t: Tables) -> DataFrame:
    return content_table(t.documents.select("doc_id", "text"), "text", max_bytes=4000)
