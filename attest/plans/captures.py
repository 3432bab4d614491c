"""Import of the captures of a test run: all of them, with their totals, or none."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attest.functions.columns import ColumnLike, as_column
from attest.operators.graph import expect_matrix, fold_captures
from attest.operators.sets import report_gate
from attest.sources.versions import Gate, Publication, publish

# The sizes and themes that every state is captured in, and the form of a state's id.
CAPTURE_DIMENSIONS = {"viewport": ("compact", "phone", "tablet", "desktop"), "theme": ("light", "dark")}
STATE_ID = r"\A[a-z-]+\z"


def capture_tables(
    states: DataFrame,
    captures: DataFrame,
    report: DataFrame,
    state: str,
    evidence: str,
    taken_at: str,
    file: ColumnLike,
    outcome: ColumnLike,
    started_at: ColumnLike,
    dims: Mapping[str, Sequence[str]] = CAPTURE_DIMENSIONS,
) -> dict[str, DataFrame]:
    """What an import writes.

    ``report``: one row of counts over the run's outcomes. ``matrix``: one row per state and combination, with a
    verdict; ``evidence`` is a column of both ``states`` and ``captures``. ``states``: each state with a map of its
    captures. ``totals``: how many states and captures.
    """
    timed = states.withColumn("started_at", as_column(started_at))
    matrix = expect_matrix(timed, captures, state, dims, metadata=evidence, taken_at=taken_at, started_at="started_at")
    folded = fold_captures(captures, [state], dims, file)
    full = states.join(folded, state, "left").withColumn("n_captures", F.coalesce("n_captures", F.lit(0)))
    totals = full.agg(F.count(F.lit(1)).alias("n_states"), F.coalesce(F.sum("n_captures"), F.lit(0)).alias("n_captures"))
    return {
        "report": report_gate(report, [], outcome),
        "matrix": matrix.select(state, *dims, "n_captures", "verdict"),
        "states": full,
        "totals": totals,
    }


def capture_gates(state: str) -> dict[str, Gate]:
    """A run that passed as a whole, ids of the usual form, and each expected capture once, fresh and of its state's kind."""
    return {
        "report": lambda t: t["report"].where(~F.col("passed")),
        "ids": lambda t: t["states"].where(~F.coalesce(F.col(state).rlike(STATE_ID), F.lit(False))),
        "captures": lambda t: t["matrix"].where(F.col("verdict") != "ok"),
    }


def capture_import(spark: SparkSession, path: str, states: DataFrame, captures: DataFrame, report: DataFrame,
                   state: str, **columns) -> Publication:
    """Publish the tables of ``capture_tables`` if every gate lets them pass; read them with ``versions.published``."""
    return publish(spark, path, capture_tables(states, captures, report, state, **columns), capture_gates(state))
