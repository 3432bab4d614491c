"""Rules on a stream."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from attest.operators.rules import Rule, check


def stream_violations(
    stream: DataFrame, rules: Sequence[Rule], key: Sequence[str], path: str, checkpoint: str,
    available_now: bool = False,
) -> StreamingQuery:
    """Append violations as they arrive. The rules keep no state, so they are those of a table."""
    writer = (
        check(stream, rules, key)
        .writeStream.format("parquet")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
    )
    return (writer.trigger(availableNow=True) if available_now else writer).start()
