"""Workflow runs and release history."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attest.functions.columns import ColumnLike, as_column, first_of
from attest.functions.predicates import is_hex
from attest.functions.state import run_skip_reason
from attest.operators.skew import SLICE_ROWS, OrderedScan, lookup_join

MAX_SAFE_INTEGER = (1 << 53) - 1


def classify_runs(
    runs: DataFrame,
    repository: str,
    event: str,
    branch: str,
    run_url_prefix: str,
) -> DataFrame:
    """Add ``problem`` (a run that must not be trusted) and ``reason`` (a run that is only passed over).

    Runs have ``id, event, head_branch, head_sha, html_url, repository, head_repository``. A run from
    another repository is a problem whatever else holds; sha and address are judged on eligible runs only.
    """
    reason = run_skip_reason("event", "head_branch", event, branch)
    eligible = reason.isNull()
    expected_url = F.concat(F.lit(run_url_prefix), F.col("id").cast("string"))
    problem = first_of(
        (~F.col("repository").eqNullSafe(F.lit(repository))
         | ~F.col("head_repository").eqNullSafe(F.lit(repository)), "repository"),
        (eligible & ~is_hex("head_sha", 40), "head_sha"),
        (eligible & ~F.col("html_url").eqNullSafe(expected_url), "html_url"),
    )
    return runs.withColumns({"problem": problem, "reason": F.when(problem.isNull(), reason)})


def eligible_runs(runs: DataFrame, repository: str, event: str, branch: str, run_url_prefix: str) -> DataFrame:
    """Runs that are neither a problem nor passed over."""
    classified = classify_runs(runs, repository, event, branch, run_url_prefix)
    return classified.where(F.col("problem").isNull() & F.col("reason").isNull()).drop("problem", "reason")


def mark_superseded(
    runs: DataFrame, by: Sequence[str], run_id: str, slice_rows: int = SLICE_ROWS
) -> DataFrame:
    """Add ``superseded``: a run of the same key has a larger id. Ids outside the safe range are ignored.

    The largest id per key is a map-side combined aggregate joined back, so a key with very many runs is
    neither sorted nor held in one task, and no look-back limit hides a newer run.
    """
    candidate = F.col(run_id).try_cast("bigint")
    newest = runs.groupBy(*by).agg(
        F.max(F.when(candidate.between(-MAX_SAFE_INTEGER, MAX_SAFE_INTEGER), candidate)).alias("__newest")
    )
    joined = lookup_join(runs, newest, by, slice_rows=slice_rows)
    return joined.withColumn("superseded", F.coalesce(F.col("__newest") > F.col(run_id), F.lit(False))).drop("__newest")


def latest_gate(
    runs: DataFrame, by: Sequence[str], run_number: str, status: str, conclusion: str
) -> DataFrame:
    """Per key, whether the run with the highest number is completed with success."""
    success = F.coalesce((F.col(status) == "completed") & (F.col(conclusion) == "success"), F.lit(False))
    return runs.groupBy(*by).agg(
        F.max(run_number).alias("run_number"), F.max_by(success, F.col(run_number)).alias("passed")
    )


def gate_for(keys: DataFrame, gates: DataFrame, on: Sequence[str]) -> DataFrame:
    """A key without any run fails its gate."""
    return keys.join(gates, list(on), "left").withColumn("passed", F.coalesce("passed", F.lit(False)))


def effective_release(
    attempts: DataFrame,
    by: Sequence[str],
    order: Sequence[str],
    release: ColumnLike,
    healthy: ColumnLike,
    slice_rows: int = SLICE_ROWS,
) -> DataFrame:
    """Add ``effective``: the release in force after each attempt, the last healthy one so far."""
    current = F.when(as_column(healthy), as_column(release))
    return OrderedScan(attempts, by, order, slice_rows).running(last={"effective": current}).result()
