"""Runs and releases over time."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attest.functions.content import digest
from attest.operators.runs import classify_runs, effective_release, gate_for, latest_gate, mark_superseded
from attest.plans.status import status_reports
from attest.queries.registry import Tables, query

REPOSITORY = "team/app"
RUN_URL = "https://ci.example.com/team/app/runs/"


def workflow_runs(t: Tables) -> DataFrame:
    """Events as workflow runs: one workflow per event type, one commit per user."""
    kind, value = F.col("event_type"), F.col("value")
    sha = digest(F.col("user_id").cast("string"))
    number = F.col("event_id").cast("string")
    return t.events.select(
        F.col("event_id").alias("id"),
        kind.alias("name"),
        kind.alias("workflow_id"),
        F.when(value < 3, "schedule").otherwise("push").alias("event"),
        F.when(value > 45, "main").when(value < 40, "release").alias("head_branch"),
        F.left(sha, F.when(F.col("user_id") == 7, 39).otherwise(40)).alias("head_sha"),
        F.concat(F.lit(RUN_URL), F.when((value >= 10) & (value < 11), F.lit("x")).otherwise(number)).alias("html_url"),
        F.when((value >= 20) & (value < 21), "fork/app").otherwise(REPOSITORY).alias("repository"),
        F.lit(REPOSITORY).alias("head_repository"),
        F.when(value < 10, "queued").otherwise("completed").alias("status"),
        F.when(value >= 10, F.when(value < 30, "success").otherwise("failure")).alias("conclusion"),
    )


RUNS = """
WITH r AS (SELECT event_id AS id, event_type, user_id, value, value < 3 AS other_event, value > 45 OR value >= 40 AS other_branch FROM events),
c AS (SELECT *, CASE WHEN value >= 20 AND value < 21 THEN 'repository' WHEN other_event OR other_branch THEN NULL
        WHEN user_id = 7 THEN 'head_sha' WHEN value >= 10 AND value < 11 THEN 'html_url' END AS problem,
      CASE WHEN value >= 20 AND value < 21 THEN NULL WHEN other_event THEN 'UNSUPPORTED_EVENT' WHEN other_branch THEN 'UNSUPPORTED_BRANCH' END AS reason FROM r)
"""


@query("eligible_runs", RUNS + "SELECT id, problem, reason FROM c")
def classified(t: Tables) -> DataFrame:
    runs = classify_runs(workflow_runs(t), REPOSITORY, "push", "release", RUN_URL)
    return runs.select("id", "problem", F.when(F.col("problem").isNull(), F.col("reason")).alias("reason"))


@query("status_reports", RUNS + """,
k AS (SELECT *, max(id) OVER (PARTITION BY event_type, user_id, other_event, CASE WHEN value > 45 THEN 'main' WHEN value < 40 THEN 'release' END) AS newest FROM c),
p AS (SELECT *, coalesce(problem, CASE WHEN event_type = 'error' THEN 'unknown_name' WHEN user_id NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 10 <> 3) THEN 'missing_commit' END) AS refused
      FROM k WHERE reason IS NULL)
SELECT id, left(sha256(CAST(user_id AS VARCHAR)), CASE WHEN user_id = 7 THEN 39 ELSE 40 END) AS head_sha,
  CASE WHEN refused IS NULL THEN concat('checks/', event_type) END AS context,
  CASE WHEN refused IS NULL THEN CASE WHEN value < 10 THEN 'pending' WHEN value < 30 THEN 'success' ELSE 'failed' END END AS state,
  concat('https://ci.example.com/team/app/runs/', CASE WHEN value >= 10 AND value < 11 THEN 'x' ELSE CAST(id AS VARCHAR) END) AS target_url,
  CASE WHEN refused IS NULL THEN concat('Checks [', event_type, ']: ', CASE WHEN value < 10 THEN 'queued' WHEN value < 30 THEN 'completed (success)' ELSE 'completed (failure)' END) END AS description,
  refused AS problem
FROM p WHERE refused IS NOT NULL OR id = newest
""")
def reports(t: Tables) -> DataFrame:
    contexts = {kind: f"checks/{kind}" for kind in ("view", "click", "signup", "purchase")}
    key = F.col("c_custkey")
    # Of every tenth customer the commit is not there.
    commit = F.when(key % 10 != 3, F.left(digest(key.cast("string")), F.lit(40)))
    commits = t.customer.select(commit.alias("id"))
    return status_reports(workflow_runs(t), REPOSITORY, contexts, RUN_URL, "Checks", commits=commits)


@query("mark_superseded", """
SELECT event_id, user_id, event_type, event_id < max(event_id) OVER (PARTITION BY user_id, event_type) AS superseded FROM events
""")
def superseded(t: Tables) -> DataFrame:
    rows = t.events.select("event_id", "user_id", "event_type")
    return mark_superseded(rows, ["user_id", "event_type"], "event_id")


@query("latest_gate", """
WITH g AS (SELECT user_id, max(event_id) AS run_number, arg_max(event_type, event_id) IN ('view', 'purchase') AS passed FROM events GROUP BY user_id)
SELECT c_custkey AS user_id, run_number, coalesce(passed, false) AS passed FROM customer LEFT JOIN g ON user_id = c_custkey
""")
def gates(t: Tables) -> DataFrame:
    kind = F.col("event_type")
    runs = t.events.select(
        "user_id", "event_id",
        F.when(kind == "click", "in_progress").otherwise("completed").alias("status"),
        F.when(kind.isin("view", "purchase"), "success").when(kind != "click", "failure").alias("conclusion"),
    )
    keys = t.customer.select(F.col("c_custkey").alias("user_id"))
    return gate_for(keys, latest_gate(runs, ["user_id"], "event_id", "status", "conclusion"), ["user_id"])


@query("effective_release", """
SELECT event_id, user_id, last_value(CASE WHEN event_type <> 'error' THEN event_id END IGNORE NULLS)
  OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS effective FROM events
""")
def releases(t: Tables) -> DataFrame:
    rows = t.events.select("event_id", "user_id", "ts", "event_type")
    result = effective_release(rows, ["user_id"], ["ts", "event_id"], "event_id", F.col("event_type") != "error")
    return result.select("event_id", "user_id", "effective")
