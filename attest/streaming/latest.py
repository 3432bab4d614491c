"""Newest status per key from a stream of runs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from attest.sources.versions import newest_stage, publish

_BATCH = "batch_id"
# Readers of the batches do not list folders with such a name.
_FOLDED = "_folded"


def newest(df: DataFrame, by: Sequence[str], rank: Sequence[str], payload: Sequence[str]) -> DataFrame:
    """One row per key: the one with the greatest rank, such as (run id, update time).

    A struct maximum combines map-side, so a key with very many updates is a handful of partial rows.
    """
    best = F.max(F.struct(*rank, *[c for c in payload if c not in rank])).alias("__best")
    return df.groupBy(*by).agg(best).select(*by, "__best.*")


def stream_latest(
    runs: DataFrame,
    by: Sequence[str],
    rank: Sequence[str],
    payload: Sequence[str],
    path: str,
    checkpoint: str,
    available_now: bool = False,
) -> StreamingQuery:
    """Keep the newest status per key in ``path``; read it with ``latest_status``.

    Each micro-batch writes only its own newest rows, into a folder named by the batch, so the work per
    batch follows the batch and not the table. Replaying a batch overwrites its folder. A late update of an
    older run lands in the table but never wins over a newer one; a newer update of the same run does.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        newest(batch, by, rank, payload).write.mode("overwrite").parquet(f"{path}/{_BATCH}={batch_id}")

    writer = runs.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def stream_updates(updates: DataFrame, path: str, checkpoint: str, available_now: bool = False) -> StreamingQuery:
    """Write what each micro-batch changed of an aggregate that may still change, such as counts of open windows.

    Read it with ``latest_status``, ranked by the value that grows. A replayed batch overwrites itself.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/{_BATCH}={batch_id}")

    writer = updates.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def latest_status(
    spark: SparkSession, path: str, schema: T.StructType, by: Sequence[str], rank: Sequence[str], payload: Sequence[str]
) -> DataFrame:
    """The current table: newest row per key over what ``fold_history`` has folded and all batches since."""
    return newest(_history(spark, path, schema, by, rank, payload)[0], by, rank, payload)


def fold_history(
    spark: SparkSession, path: str, schema: T.StructType, by: Sequence[str], rank: Sequence[str], payload: Sequence[str]
) -> int | None:
    """Fold the batches written so far into one table that readers take in their place; the stream may be running.

    The newest batch is left out: it may still be being written, or be replayed. The stream itself is not touched, it
    goes on to add batches. Returns the last batch that is folded, whose folder and those before no later reader
    opens; null if there is nothing to fold.
    """
    rows, folded = _history(spark, path, schema, by, rank, payload)
    last = rows.agg(F.max(_BATCH)).first()[0]
    if last is None or last - 1 <= (-1 if folded is None else folded):
        return folded
    upto = last - 1
    tables = {
        "rows": newest(rows.where(F.col(_BATCH) <= upto), by, rank, payload),
        "upto": spark.range(1).select(F.lit(upto).cast("bigint").alias(_BATCH)),
    }
    publish(spark, f"{path}/{_FOLDED}", tables, {})
    return upto


def _history(spark: SparkSession, path: str, schema: T.StructType, by: Sequence[str], rank: Sequence[str],
             payload: Sequence[str]) -> tuple[DataFrame, int | None]:
    """Folded rows and those of later batches, with their batch, and the last batch that is folded."""
    columns = list(dict.fromkeys([*by, *rank, *payload]))
    typed = T.StructType([T.StructField(c, schema[c].dataType) for c in columns])
    batches = spark.read.schema(typed).parquet(path).withColumn(_BATCH, F.col(_BATCH).cast("bigint"))
    # One version, so that the folded rows and the batch that they reach to belong together.
    stage = newest_stage(spark, f"{path}/{_FOLDED}")
    if stage is None:
        return batches, None
    upto = spark.read.parquet(f"{stage}/upto").first()[_BATCH]
    folded = spark.read.schema(typed).parquet(f"{stage}/rows").withColumn(_BATCH, F.lit(upto).cast("bigint"))
    return batches.where(F.col(_BATCH) > upto).unionByName(folded), upto


def compact(
    spark: SparkSession, path: str, into: str, schema: T.StructType, by: Sequence[str], rank: Sequence[str],
    payload: Sequence[str],
) -> None:
    """Write the current table to a new folder in the same form, as the start of a shorter history."""
    latest_status(spark, path, schema, by, rank, payload).write.mode("overwrite").parquet(f"{into}/{_BATCH}=-1")
