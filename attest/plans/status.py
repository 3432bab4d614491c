"""Status reports of workflow runs."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attest.functions.columns import first_of
from attest.functions.state import map_run_state
from attest.functions.text import describe_run
from attest.operators.reconcile import lookup_context
from attest.operators.runs import classify_runs, mark_superseded
from attest.operators.skew import SLICE_ROWS, lookup_join


def status_reports(
    runs: DataFrame,
    repository: str,
    contexts: Mapping[str, str],
    run_url_prefix: str,
    source: str,
    event: str = "push",
    branch: str = "release",
    commits: DataFrame | None = None,
    slice_rows: int = SLICE_ROWS,
) -> DataFrame:
    """The status to report for each newest eligible run of a workflow and commit, and the runs to refuse.

    A run is compared with every listed run of its workflow, commit, event and branch, whether those can be trusted or
    not: an untrusted newer run keeps an older one from being reported. Refused runs come with ``problem`` and without
    a state: one of another repository, with a bad commit or address, of an unknown name, or, where ``commits(id)`` is
    given, of a commit that is not there. Runs of other events and branches are passed over.
    """
    classified = classify_runs(runs, repository, event, branch, run_url_prefix)
    marked = mark_superseded(classified, ["workflow_id", "head_sha", "event", "head_branch"], "id", slice_rows)
    named = lookup_context(marked.where(F.col("reason").isNull()), "name", contexts)
    if commits is None:
        named = named.withColumn("__there", F.lit(True))
    else:
        there = commits.select(F.col("id").alias("head_sha")).distinct().withColumn("__there", F.lit(True))
        named = lookup_join(named, there, ["head_sha"], slice_rows=slice_rows)
    problem = F.coalesce("problem", first_of((F.col("unknown_name"), "unknown_name"), (F.col("__there").isNull(), "missing_commit")))
    judged = named.withColumn("problem", problem).where(F.col("problem").isNotNull() | ~F.col("superseded"))
    sound = F.col("problem").isNull()
    return judged.select(
        "id",
        "head_sha",
        F.when(sound, F.col("context")).alias("context"),
        F.when(sound, map_run_state("status", "conclusion")).alias("state"),
        F.col("html_url").alias("target_url"),
        F.when(sound, describe_run(F.lit(source), "name", "status", "conclusion")).alias("description"),
        "problem",
    )
