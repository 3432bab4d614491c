"""The streaming operators, driven by the events file as a stream."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attest.operators.access import request_counts
from attest.operators.rules import Rule
from attest.queries.access import CLICKS, EVERYTHING, FLOWS, LIFETIME, RATE_SQL
from attest.queries.registry import Tables, query
from attest.session import fresh_folder
from attest.streaming.keyed import stream_flow_state, stream_rate_limit, stream_session_state
from attest.streaming.latest import latest_status, stream_latest, stream_updates
from attest.streaming.violations import stream_violations


def event_stream(t: Tables) -> DataFrame:
    schema = t.events.schema
    reader = t.spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet")
    return reader.parquet(t.folder)


def drained(t: Tables, stream: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """Run a stream over everything there is now and read back what it wrote."""
    folder = fresh_folder(t.spark, name)
    query_handle = (
        stream.writeStream.format("parquet")
        .option("path", f"{folder}/rows")
        .option("checkpointLocation", f"{folder}/progress")
        .outputMode(mode)
        .trigger(availableNow=True)
        .start()
    )
    query_handle.awaitTermination()
    return t.spark.read.schema(stream.schema).parquet(f"{folder}/rows")


@query("stream_latest", """
SELECT user_id, event_id, event_type AS status FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) = 1
""")
def latest(t: Tables) -> DataFrame:
    folder = fresh_folder(t.spark, "latest")
    runs = event_stream(t).select("user_id", "event_id", F.col("event_type").alias("status"))
    by, rank, payload = ["user_id"], ["event_id"], ["status"]
    stream_latest(runs, by, rank, payload, f"{folder}/rows", f"{folder}/progress", available_now=True).awaitTermination()
    return latest_status(t.spark, f"{folder}/rows", runs.schema, by, rank, payload)


@query("stream_rate_limit", RATE_SQL)
def streamed_rates(t: Tables) -> DataFrame:
    result = stream_rate_limit(event_stream(t), "user_id", "ts", "event_id", EVERYTHING, CLICKS,
                               F.col("event_type") == "click")
    return drained(t, result, "rates").select("event_id", "allowed")


@query("stream_rate_limit_in_order", RATE_SQL)
def ordered_rates(t: Tables) -> DataFrame:
    """Requests wait for the watermark; without a delay it passes the last of them when the file has been read."""
    result = stream_rate_limit(event_stream(t), "user_id", "ts", "event_id", EVERYTHING, CLICKS,
                               F.col("event_type") == "click", watermark="0 seconds", wait=True)
    return drained(t, result, "ordered-rates").select("event_id", "allowed")


@query("stream_request_counts", """
SELECT user_id, CAST(epoch(date_trunc('day', ts)) AS BIGINT) AS window_start, count(*) AS n_requests, count(*) > 3 AS breach FROM events GROUP BY 1, 2
""")
def streamed_counts(t: Tables) -> DataFrame:
    """Every window with what has been counted so far, the open ones too."""
    folder = fresh_folder(t.spark, "counts")
    counts = request_counts(event_stream(t).select("user_id", "ts"), "user_id", "ts", "1 day", budget=3, watermark="1 day")
    stream_updates(counts, f"{folder}/rows", f"{folder}/progress", available_now=True).awaitTermination()
    return latest_status(t.spark, f"{folder}/rows", counts.schema, ["user_id", "window_start"], ["n_requests"], ["breach"])


@query("stream_flow_state", FLOWS + """
SELECT event_id, CASE WHEN gen = 0 THEN 'none' WHEN ts > issued_at + INTERVAL 2 DAY THEN 'expired' WHEN attempt > 2 THEN 'exhausted' ELSE 'open' END AS state
FROM g WHERE event_type <> 'signup'
""")
def streamed_flows(t: Tables) -> DataFrame:
    kind = F.col("event_type")
    result = stream_flow_state(event_stream(t), "user_id", "ts", "event_id", kind == "signup", kind.isin("click", "view"),
                               lifetime_seconds=LIFETIME, max_submissions=2)
    return drained(t, result, "flows").select("event_id", "state")


@query("stream_session_state", """
WITH m AS (SELECT event_id, ts,
   last_value(CASE WHEN event_type IN ('signup', 'error') THEN event_type END IGNORE NULLS) OVER w AS kind,
   last_value(CASE WHEN event_type IN ('signup', 'error') THEN ts END IGNORE NULLS) OVER w AS marked_at
 FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
SELECT event_id, coalesce(kind = 'signup' AND ts < marked_at + INTERVAL 24 HOUR, false) AS active FROM m
""")
def streamed_sessions(t: Tables) -> DataFrame:
    kind = F.col("event_type")
    result = stream_session_state(event_stream(t), "user_id", "ts", "event_id", kind == "signup", kind == "error",
                                  lifetime_seconds=86_400)
    return drained(t, result, "sessions").select("event_id", "active")


@query("stream_violations", """
SELECT event_id, 'kind' AS rule, CAST(1 AS BIGINT) AS ordinal, event_type AS value FROM events WHERE event_type = 'error'
UNION ALL SELECT event_id, 'value', 2, NULL FROM events WHERE NOT value < 30
""")
def streamed_violations(t: Tables) -> DataFrame:
    rules = [Rule("kind", F.col("event_type") != "error", F.col("event_type")), Rule("value", F.col("value") < 30)]
    folder = fresh_folder(t.spark, "violations")
    stream = event_stream(t)
    stream_violations(stream, rules, ["event_id"], f"{folder}/rows", f"{folder}/progress", True).awaitTermination()
    return t.spark.read.schema("event_id long, rule string, ordinal long, value string").parquet(f"{folder}/rows")
