"""Provenance of a deployable artefact."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attest.functions.predicates import is_hex
from attest.operators.rules import Rule, first_failure


def deploy_rules(repository: str, platform: str) -> list[Rule]:
    return [
        Rule("expected_commit", is_hex("expected_commit", 40)),
        Rule("expected_backend", is_hex("expected_backend", 40)),
        Rule("repository", F.col("repository").eqNullSafe(F.lit(repository))),
        Rule("commit", F.col("commit").eqNullSafe(F.col("expected_commit"))),
        Rule("backend", F.col("backend").eqNullSafe(F.col("expected_backend"))),
        Rule("platform", F.col("platform").eqNullSafe(F.lit(platform))),
        Rule("sha256", F.col("sha256").eqNullSafe(F.col("content_sha256"))),
    ]


def deploy_check(df: DataFrame, repository: str, platform: str = "linux-amd64") -> DataFrame:
    """Add ``problem`` (the first provenance field that differs) and ``deployable``.

    Rows hold the manifest (``repository, commit, backend, platform, sha256``) and what is expected of it
    (``expected_commit, expected_backend, content_sha256``).
    """
    checked = first_failure(df, deploy_rules(repository, platform), "problem")
    return checked.withColumn("deployable", F.col("problem").isNull())
