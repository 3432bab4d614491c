"""Tables published as a whole or not at all.

A publication writes its tables to a new folder, judges what it wrote, and only then adds a pointer to it. Readers follow the newest
pointer, so they see the version before until the new one is complete and judged. Everything is read and written by
Spark, so ``path`` may lie in any store that it reaches.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Mapping
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_POINTER = "version bigint, stage string"

#: Rows of the staged tables that speak against publication.
Gate = Callable[[Mapping[str, DataFrame]], DataFrame]


@dataclass(frozen=True)
class Publication:
    """``version`` is null if a gate failed; ``failed`` names the gates, ``stage`` the folder with what was written."""

    version: int | None
    failed: tuple[str, ...]
    stage: str


def publish(spark: SparkSession, path: str, tables: Mapping[str, DataFrame], gates: Mapping[str, Gate]) -> Publication:
    """Stage ``tables``, judge them by every gate and commit them as the next version if no gate finds a row.

    A refused stage stays where it is, so that its tables can tell why; no reader is led to it. Of two writers that
    take the same number, the one whose pointer comes second fails.
    """
    latest = _latest(spark, path)
    stage = f"{path}/stages/{uuid.uuid4().hex}"
    for name, table in tables.items():
        table.write.parquet(f"{stage}/{name}")
    staged = {name: spark.read.schema(table.schema).parquet(f"{stage}/{name}") for name, table in tables.items()}
    failed = tuple(name for name, gate in gates.items() if not gate(staged).isEmpty())
    if failed:
        return Publication(None, failed, stage)
    version = (latest[0] if latest else 0) + 1
    pointer = spark.range(1).select(F.lit(version).cast("bigint").alias("version"), F.lit(stage).alias("stage"))
    pointer.coalesce(1).write.mode("error").parquet(f"{path}/pointers/{version:012d}")
    return Publication(version, (), stage)


def published(spark: SparkSession, path: str, name: str) -> DataFrame | None:
    """A table of the newest version; none before the first."""
    stage = newest_stage(spark, path)
    return spark.read.parquet(f"{stage}/{name}") if stage else None


def newest_stage(spark: SparkSession, path: str) -> str | None:
    """Folder of the newest version, for readers that need several of its tables to belong together."""
    latest = _latest(spark, path)
    return latest[1] if latest else None


def _latest(spark: SparkSession, path: str) -> tuple[int, str] | None:
    try:
        pointers = spark.read.schema(_POINTER).parquet(f"{path}/pointers/*")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return None
    # One row whatever the number of versions.
    best = pointers.agg(F.max(F.struct("version", "stage")).alias("p")).first()["p"]
    return (best["version"], best["stage"]) if best else None
