"""Policy of workflow jobs and their steps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attest.operators.rules import Rule, check

# What a job may use.
MAX_MINUTES = 60
PINNED = r"@[0-9a-f]{40}\z"


def explode_steps(jobs: DataFrame) -> DataFrame:
    """One row per step of nested jobs: ``job, position, uses, run, with``."""
    return jobs.select(F.col("name").alias("job"), F.posexplode("steps").alias("position", "s")).select(
        "job", F.col("position").cast("bigint").alias("position"), "s.uses", "s.run", F.col("s.with").alias("with")
    )


def job_rules() -> list[Rule]:
    minutes = F.col("timeout_minutes")
    return [
        Rule("hosted_runner", ~F.contains(F.coalesce("runs_on", F.lit("")), F.lit("self-hosted")), F.col("runs_on")),
        Rule("timeout", (minutes > 0) & (minutes <= MAX_MINUTES), minutes),
    ]


def step_rules(artefact_action: str = "actions/upload-artifact@", forbidden_path: str = "test-results") -> list[Rule]:
    uses = F.col("uses")
    artefact = F.coalesce(uses.startswith(artefact_action), F.lit(False))
    return [
        Rule("pinned", uses.isNull() | uses.rlike(PINNED), uses),
        Rule("artefact_required", ~artefact | (F.col("with")["if-no-files-found"] == "error"), uses),
        Rule("artefact_path", ~artefact | ~F.contains(F.col("with")["path"], F.lit(forbidden_path)), uses),
    ]


def step_order(steps: DataFrame, job: str, position: str, first: Column, then: Column) -> DataFrame:
    """Per job, whether the first step matching ``first`` comes before the first matching ``then``.

    Both positions are minima, so steps are never gathered; ``ok`` is false when either is absent.
    """
    facts = steps.groupBy(job).agg(
        F.min(F.when(first, F.col(position))).alias("first_at"),
        F.min(F.when(then, F.col(position))).alias("then_at"),
    )
    return facts.withColumn("ok", F.coalesce(F.col("first_at") < F.col("then_at"), F.lit(False)))


def job_policy(jobs: DataFrame, first: Column | None = None, then: Column | None = None) -> DataFrame:
    """Violations of nested jobs: ``job, position, rule, value`` (no position for a rule of the whole job)."""
    none = F.lit(None).cast("bigint")
    steps = explode_steps(jobs)
    whole = check(jobs.withColumnRenamed("name", "job"), job_rules(), ["job"]).withColumn("position", none)
    each = check(steps, step_rules(), ["job", "position"])
    columns = ["job", "position", "rule", "value"]
    result = whole.select(*columns).unionByName(each.select(*columns))
    if first is not None and then is not None:
        order = step_order(steps, "job", "position", first, then).where(~F.col("ok")).select(
            "job", none.alias("position"), F.lit("step_order").alias("rule"), F.lit(None).cast("string").alias("value")
        )
        result = result.unionByName(order)
    return result
