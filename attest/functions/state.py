"""States of workflow runs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from attest.functions.columns import ColumnLike, as_column, first_of

# How a finished run's conclusion is reported.
CONCLUSION_STATES = {
    "success": ("success",),
    "failed": ("failure", "timed_out", "action_required"),
    "canceled": ("cancelled",),
    "skipped": ("skipped", "neutral"),
}


def map_run_state(status: ColumnLike, conclusion: ColumnLike) -> Column:
    """Commit state of a run: unknown conclusions fail, unknown statuses are still pending."""
    s, c = as_column(status), as_column(conclusion)
    done = s == "completed"
    return first_of(
        (s == "in_progress", "running"),
        *[(done & c.isin(*names), state) for state, names in CONCLUSION_STATES.items()],
        (done, "failed"),
        otherwise=F.lit("pending"),
    )


def run_skip_reason(event: ColumnLike, branch: ColumnLike, allowed_event: str, allowed_branch: str) -> Column:
    """Why a run is passed over, null when it is eligible. A missing value is not the allowed one."""
    return first_of(
        (~as_column(event).eqNullSafe(allowed_event), "UNSUPPORTED_EVENT"),
        (~as_column(branch).eqNullSafe(allowed_branch), "UNSUPPORTED_BRANCH"),
    )
