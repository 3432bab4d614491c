"""Streams in several micro-batches give the rows of the table."""

import random
from collections import Counter

import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from attest.operators.access import MUTATIONS, flow_state, rate_limit, request_counts, session_state
from attest.operators.rules import Rule, check
from attest.streaming.keyed import _Sequential, stream_flow_state, stream_rate_limit, stream_session_state
from attest.streaming.latest import compact, fold_history, latest_status, newest, stream_latest
from attest.streaming.violations import stream_violations

SCHEMA = "user int, id long, at long, kind string"
START = 1_700_000_000


@pytest.fixture(scope="module")
def history():
    rng = random.Random(3)
    times = sorted(rng.randrange(0, 40_000) for _ in range(400))
    return [(rng.choice([0, 0, 1, 2, 3, 4]), i, START + t, rng.choice(["start", "try", "try", "stop"])) for i, t in enumerate(times)]


def stream_of(spark, folder, rows, size=100):
    for start in range(0, len(rows), size):
        spark.createDataFrame(rows[start:start + size], SCHEMA).coalesce(1).write.mode("append").parquet(folder)
    return timed(spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(folder))


def timed(df):
    return df.withColumn("ts", F.timestamp_seconds("at"))


def drain(stream, folder):
    writer = stream.writeStream.format("parquet").option("path", f"{folder}/out")
    writer.option("checkpointLocation", f"{folder}/progress").trigger(availableNow=True).start().awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{folder}/out")


def rows(df):
    return Counter(tuple(r) for r in df.collect())


def test_flow_and_session_states(spark, tmp_path, history):
    table = timed(spark.createDataFrame(history, SCHEMA))
    stream = stream_of(spark, str(tmp_path / "in"), history)
    kind = F.col("kind")
    flows = stream_flow_state(stream, "user", "ts", "id", kind == "start", kind == "try")
    expected = flow_state(table.where("kind = 'start'"), table.where("kind = 'try'"), "user", "ts", "id")
    assert rows(drain(flows, str(tmp_path / "flows")).select("id", "state")) == rows(expected.select("id", "state"))
    assert {r["state"] for r in expected.select("state").distinct().collect()} >= {"none", "expired", "open"}
    sessions = stream_session_state(stream, "user", "ts", "id", kind == "start", kind == "stop", 900)
    expected = session_state(table, "user", "ts", "id", kind == "start", kind == "stop", 900)
    assert rows(drain(sessions, str(tmp_path / "sessions")).select("id", "active")) == rows(expected.select("id", "active"))


def settled(df, table, delay=60):
    """Ids that the watermark has passed at the end of the stream."""
    last = table.agg(F.max("at")).first()[0]
    return df.join(table.where(F.col("at") <= last - delay).select("id"), "id", "left_semi")


def shuffled(history, within=60):
    """The same rows, each brought up to ``within`` seconds late."""
    rng = random.Random(5)
    return sorted(history, key=lambda r: r[2] + rng.randrange(within))


def test_waiting_flows_and_sessions_of_rows_out_of_order(spark, tmp_path, history):
    table = timed(spark.createDataFrame(history, SCHEMA))
    stream = stream_of(spark, str(tmp_path / "in"), shuffled(history))
    kind = F.col("kind")
    flows = stream_flow_state(stream, "user", "ts", "id", kind == "start", kind == "try", wait=True)
    expected = flow_state(table.where("kind = 'start'"), table.where("kind = 'try'"), "user", "ts", "id")
    assert rows(drain(flows, str(tmp_path / "flows")).select("id", "state")) == rows(settled(expected, table).select("id", "state"))
    assert {r["state"] for r in expected.select("state").distinct().collect()} >= {"none", "expired", "open"}
    sessions = stream_session_state(stream, "user", "ts", "id", kind == "start", kind == "stop", 900, wait=True)
    expected = session_state(table, "user", "ts", "id", kind == "start", kind == "stop", 900)
    assert rows(drain(sessions, str(tmp_path / "sessions")).select("id", "active")) == rows(settled(expected, table).select("id", "active"))


def test_rates_of_rows_out_of_order(spark, tmp_path):
    rng = random.Random(11)
    history = [(rng.choice([None, 0, 0, 0, 1]), i, START + t // 4, rng.choice(["get", "put"])) for i, t in enumerate(sorted(rng.randrange(2000) for _ in range(1200)))]
    table = timed(spark.createDataFrame(history, SCHEMA))
    stream = stream_of(spark, str(tmp_path / "in"), shuffled(history), size=300)
    put = F.col("kind") == "put"
    got = drain(stream_rate_limit(stream, "user", "ts", "id", mutations=MUTATIONS, is_mutation=put, wait=True), str(tmp_path / "rates"))
    expected = rate_limit(table, "user", "ts", "id", mutations=MUTATIONS, is_mutation=put).where("user IS NOT NULL")
    got = got.where("user IS NOT NULL")
    assert rows(got.select("user", "id", "allowed")) == rows(settled(expected, table).select("user", "id", "allowed"))
    assert {r[0] for r in got.select("allowed").distinct().collect()} == {True, False}


def test_late_rows_are_reported_and_change_nothing(spark, tmp_path):
    hour = 3600
    history = [(1, 1, START, "start"), (1, 2, START + 10, "try"), (2, 3, START + hour, "stop"),
               # These come when the watermark is beyond them: a start, a submission, and one of no flow.
               (1, 4, START + 5, "start"), (1, 5, START + 6, "try"), (None, 6, START + 7, "try"), (2, 7, START + 2 * hour, "stop"),
               (None, 9, START + 2 * hour, "try"), (1, 8, START + 90 * 86_400, "try"), (2, 10, START + 91 * 86_400, "stop")]
    stream = stream_of(spark, str(tmp_path / "in"), history, size=3)
    kind = F.col("kind")
    for wait in (False, True):
        flows = stream_flow_state(stream, "user", "ts", "id", kind == "start", kind == "try", wait=wait)
        # After ninety days the flow is still known.
        assert rows(drain(flows, str(tmp_path / f"flows-{wait}"))) == Counter({
            (1, 2, "open"): 1, (1, 4, "late"): 1, (1, 5, "late"): 1, (None, 6, "late"): 1, (None, 9, "none"): 1, (1, 8, "expired"): 1})


def test_request_counts(spark, tmp_path, history):
    table = request_counts(timed(spark.createDataFrame(history, SCHEMA)), "user", "ts", "10 minutes", 3)
    last = max(r[2] for r in history)
    stream = request_counts(stream_of(spark, str(tmp_path / "in"), history), "user", "ts", "10 minutes", 3, "1 hour")
    closed = table.where(F.col("window_start") + 600 <= last - 3600)
    assert rows(drain(stream, str(tmp_path / "counts"))) == rows(closed)


def test_violations(spark, tmp_path, history):
    rules = [Rule("kind", F.col("kind") != "stop", F.col("kind")), Rule("user", F.col("user") > 0, F.col("user"))]
    stream = stream_of(spark, str(tmp_path / "in"), history)
    stream_violations(stream, rules, ["id"], str(tmp_path / "out"), str(tmp_path / "p"), True).awaitTermination()
    expected = check(spark.createDataFrame(history, SCHEMA), rules, ["id"])
    assert rows(spark.read.parquet(str(tmp_path / "out"))) == rows(expected)


def test_latest_never_goes_back_and_survives_replay(spark, tmp_path):
    # (user, run id, update time, status): run 5 advances, then an older run and an old update arrive late.
    updates = [(1, 5, START, "queued"), (1, 5, START + 9, "completed"), (1, 3, START + 50, "late"), (1, 5, START + 4, "running"), (2, 1, START, "queued")]
    stream = stream_of(spark, str(tmp_path / "in"), updates, size=1)
    path, progress = str(tmp_path / "rows"), str(tmp_path / "progress")
    by, rank, payload = ["user"], ["id", "at"], ["kind"]
    stream_latest(stream, by, rank, payload, path, progress, True).awaitTermination()
    expected = Counter({(1, 5, START + 9, "completed"): 1, (2, 1, START, "queued"): 1})
    assert rows(latest_status(spark, path, stream.schema, by, rank, payload)) == expected
    # A batch that failed after writing is written again under the same number.
    batch = newest(spark.createDataFrame([updates[1]], SCHEMA), by, rank, payload)
    batch.write.mode("overwrite").parquet(f"{path}/batch_id=1")
    assert rows(latest_status(spark, path, stream.schema, by, rank, payload)) == expected
    compact(spark, path, str(tmp_path / "short"), stream.schema, by, rank, payload)
    assert rows(latest_status(spark, str(tmp_path / "short"), stream.schema, by, rank, payload)) == expected


def test_history_is_folded_under_a_stream(spark, tmp_path):
    updates = [(1, 5, START, "queued"), (2, 1, START, "queued"), (1, 5, START + 9, "completed"), (1, 3, START + 50, "late"),
               (3, 1, START, "queued"), (2, 2, START + 1, "running")]
    folder, path, progress = (str(tmp_path / n) for n in ("in", "rows", "progress"))
    by, rank, payload = ["user"], ["id", "at"], ["kind"]

    def arrive(part):
        stream = stream_of(spark, folder, part, size=1)
        stream_latest(stream, by, rank, payload, path, progress, True).awaitTermination()
        return stream.schema

    def current():
        return latest_status(spark, path, schema, by, rank, payload)

    schema = arrive(updates[:1])
    # The only batch may still be replayed.
    assert fold_history(spark, path, schema, by, rank, payload) is None
    arrive(updates[1:4])
    before = current()
    held = rows(before)
    assert fold_history(spark, path, schema, by, rank, payload) == 2
    assert rows(current()) == held == rows(before) == Counter({(1, 5, START + 9, "completed"): 1, (2, 1, START, "queued"): 1})
    # Nothing new to fold; the last batch is written again, as after a failure.
    assert fold_history(spark, path, schema, by, rank, payload) == 2
    newest(spark.createDataFrame(updates[3:4], SCHEMA), by, rank, payload).write.mode("overwrite").parquet(f"{path}/batch_id=3")
    arrive(updates[4:])
    expected = Counter({(1, 5, START + 9, "completed"): 1, (2, 2, START + 1, "running"): 1, (3, 1, START, "queued"): 1})
    assert rows(current()) == expected
    assert fold_history(spark, path, schema, by, rank, payload) == 4
    assert rows(current()) == expected
    plan = current()._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "_folded" in plan


def test_a_start_comes_before_a_submission_of_the_same_time(spark, tmp_path):
    # The submission has the smaller id.
    history = [(1, 1, START, "click"), (1, 2, START, "start"), (2, 3, START, "click")]
    stream = stream_of(spark, str(tmp_path / "in"), history)
    kind = F.col("kind")
    result = stream_flow_state(stream, "user", "ts", "id", kind == "start", kind == "click")
    assert rows(drain(result, str(tmp_path / "flows"))) == Counter({(1, 1, "open"): 1, (2, 3, "none"): 1})


def test_requests_without_a_key_are_not_limited(spark, tmp_path):
    history = [(None, i, START, "get") for i in range(60)] + [(1, 100 + i, START, "get") for i in range(60)]
    stream = stream_of(spark, str(tmp_path / "in"), history)
    got = Counter((r["user"], r["allowed"]) for r in drain(stream_rate_limit(stream, "user", "ts", "id"), str(tmp_path / "rates")).collect())
    assert got[None, True] == 60 and got[1, True] == 21 and got[1, False] == 39


def test_state_is_asked_for_once_a_key():
    """Every call of the state store is a round trip: a key that waits needs five, whatever the number of its rows."""
    calls, held = [], {}

    class State:
        def __init__(self, name):
            self.name = name

        def __getattr__(self, method):
            def call(*args):
                calls.append(method)
                if method == "appendValue":
                    held.setdefault(self.name, []).append(args[0])
                elif method in ("update", "clear"):
                    held[self.name] = args[0] if args else None
                return held.get(self.name) or ([] if self.name == "waiting" else None) if method == "get" else held.get(self.name) is not None

            return call

    handle = State("timers")
    handle.getValueState = handle.getListState = lambda name, schema: State(name)
    work = _Sequential(pa.int64(), (0,), lambda state, tick, a, b: ((state[0] + 1,), state[0]), 10, 1000, False, None, True)
    work.init(handle)
    frame = pd.DataFrame({"tick": [5, 3, 4], "flag": [False] * 3, "flag2": [False] * 3, "row": [1, 2, 3]})
    at = type("Timer", (), {"getCurrentWatermarkInMs": lambda self: self.now})()
    at.now = 1
    assert not list(work.handleInputRows(("k",), iter([frame]), at))
    calls.clear()
    at.now = 9
    out = pd.concat(work.handleExpiredTimer(("k",), at, None))
    assert list(out["row"]) == [2, 3, 1] and list(out["result"]) == [0, 1, 2] and held["current"] == (3, 5)
    assert calls == ["get", "clear", "get", "update", "registerTimer"]
