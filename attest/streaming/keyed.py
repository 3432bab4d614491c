"""Keyed state for the sequential rules: request budgets, flows and sessions.

A key's rows are taken in order of time within a micro-batch, and at once. With ``wait`` they wait in the state store
until the watermark has passed them and are then taken in order of time, however the micro-batches brought them: the
verdict is that of the table and comes as late as the watermark's delay. In both forms a row that arrives behind the
watermark can no longer take its place: it comes out with the verdict ``late`` (null where verdicts are boolean) and
changes no state.

Of each row only its time, its flags and its id are held, as Arrow batches; with ``wait`` in the key's list state, one
item for each batch that Spark hands over. State that can no longer matter is dropped by an event-time timer; nothing
that could is. Timers need Spark's RocksDB state store, which these functions choose for the session.
"""

from __future__ import annotations

from collections.abc import Callable, Generator, Iterator, Sequence

import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from attest.operators.access import (
    CODE_LIFETIME_SECONDS,
    MAX_SUBMISSIONS,
    SESSION_LIFETIME_SECONDS,
    ALL_REQUESTS,
    Bucket,
    LeakyBuckets,
)
from attest.session import ship_with_plans

ship_with_plans(__name__)

# Spark hands rows over as named tuples: names of columns have to be plain words.
_KEY, _ROW, _TICK, _FLAG, _FLAG2, _RESULT = "key", "row", "tick", "flag", "flag2", "result"
#: Rows of one piece of output.
_PIECE = 10_000

# A step takes (state, time in units of ``unit_us`` microseconds, flag, second flag) and returns (state, result).
Step = Callable[[tuple, int, bool, bool], tuple[tuple, object]]


def _rocksdb(spark: SparkSession) -> None:
    setting = "spark.sql.streaming.stateStore.providerClass"
    if "RocksDB" not in spark.conf.get(setting):
        spark.conf.set(setting, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


class _Sequential(StatefulProcessor):
    def __init__(self, row_type: pa.DataType, start: tuple, step: Step, keep_ms: int | None, unit_us: int,
                 flagged_first: bool, late: object, wait: bool):
        self.schema = pa.schema([(_TICK, pa.int64()), (_FLAG, pa.bool_()), (_FLAG2, pa.bool_()), (_ROW, row_type)])
        self.start, self.step, self.keep_ms, self.unit_us = start, step, keep_ms, unit_us
        self.late, self.wait = late, wait
        self.order = [(_TICK, "ascending"), *([(_FLAG, "descending")] if flagged_first else []), (_ROW, "ascending")]

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        # The last column is the time of the last row taken.
        numbers = [T.StructField(f"s{i}", T.LongType()) for i in range(len(self.start))] + [T.StructField("last", T.LongType())]
        self.current = handle.getValueState("current", T.StructType(numbers))
        self.waiting = handle.getListState("waiting", T.StructType([T.StructField("batch", T.BinaryType())]))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs()
        fresh = []
        for frame in rows:
            batch = pa.Table.from_arrays([pa.array(frame[f.name], f.type, from_pandas=True) for f in self.schema], schema=self.schema)
            late, batch = self._split(batch, passed)
            if late.num_rows:
                yield self._output(key, late, [self.late] * late.num_rows)
            if self.wait:
                self._store(batch)
            elif batch.num_rows:
                fresh.append(batch)
        if fresh:
            last = yield from self._taken(key, self._ordered(fresh))
            self._expire(last, passed)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs()
        batches = [pa.ipc.open_stream(r[0]).read_all() for r in self.waiting.get()] if self.wait else []
        last = None
        if batches:
            ready, later = zip(*(self._split(b, passed) for b in batches))
            self.waiting.clear()
            self._store(pa.concat_tables(later))
            last = yield from self._taken(key, self._ordered(ready))
        if last is None and (state := self.current.get()) is not None:
            last = state[-1]
        self._expire(last, passed)

    def _expire(self, last: int | None, passed: int) -> None:
        """Drop the state, or come back when it may be dropped. ``last`` is the time that it holds."""
        if self.keep_ms is None or last is None:
            return
        until = last * self.unit_us // 1000 + self.keep_ms
        if until > passed:
            self.handle.registerTimer(until)
        else:
            self.current.clear()

    def _split(self, batch: pa.Table, passed: int) -> tuple[pa.Table, pa.Table]:
        """The rows that the watermark has passed, and the others; a row of its own millisecond counts as passed."""
        behind = batch[_TICK].to_numpy() < (passed + 1) * 1000 // self.unit_us
        if behind.all():
            return batch, batch.slice(0, 0)
        if not behind.any():
            return batch.slice(0, 0), batch
        return batch.filter(pa.array(behind)), batch.filter(pa.array(~behind))

    def _ordered(self, batches: Sequence[pa.Table]) -> pa.Table:
        batch = pa.concat_tables(batches)
        ticks = batch[_TICK].to_numpy()
        return batch if (ticks[1:] > ticks[:-1]).all() else batch.sort_by(self.order)

    def _store(self, batch: pa.Table) -> None:
        if not batch.num_rows:
            return
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, batch.schema) as writer:
            writer.write_table(batch)
        self.waiting.appendValue((sink.getvalue().to_pybytes(),))
        first = pc.min(batch[_TICK]).as_py() * self.unit_us // 1000
        # A timer expires when the watermark is beyond it.
        self.handle.registerTimer(first - 1)

    def _taken(self, key, batch: pa.Table) -> Generator[pd.DataFrame, None, int | None]:
        """Take rows in their order; returns the time of the last."""
        if not batch.num_rows:
            return None
        held = self.current.get()
        state = self.start if held is None else tuple(None if v is None or pd.isna(v) else int(v) for v in held[:-1])
        last = None
        for at in range(0, batch.num_rows, _PIECE):
            piece = batch.slice(at, _PIECE)
            results = []
            for last, flag, flag2 in zip(*(piece[c].to_pylist() for c in (_TICK, _FLAG, _FLAG2))):
                state, result = self.step(state, last, flag, flag2)
                results.append(result)
            yield self._output(key, piece, results)
        self.current.update((*state, last))
        return last

    def _output(self, key, rows: pa.Table, results: list) -> pd.DataFrame:
        return pd.DataFrame({_KEY: [key[0]] * len(results), _ROW: rows[_ROW].to_pandas(), _RESULT: results})


def _keyed(
    stream: DataFrame,
    key: str,
    ts: str,
    row_id: str,
    flags: tuple[Column, Column],
    watermark: str,
    name: str,
    result_type: T.DataType,
    start: tuple,
    step: Step,
    keep_ms: int | None,
    unit_us: int = 1,
    flagged_first: bool = False,
    late: object = None,
    wait: bool = False,
) -> DataFrame:
    """Run ``step`` over each key's rows and emit ``key, row_id, name``.

    Rows are taken by time and ``row_id``; with ``flagged_first``, of equal times those with the first flag come
    first. State is dropped ``keep_ms`` after a key's last row, never where that is None.
    """
    _rocksdb(stream.sparkSession)
    # Spark drops late rows by the marked column; the tick is not marked, so they come through and are reported.
    # The key goes as text, so that a null is a key like any other.
    text = F.coalesce(F.concat(F.lit("="), F.col(key).cast("string")), F.lit(""))
    timed = (
        stream.withColumn("__at", F.col(ts).cast("timestamp"))
        .withWatermark("__at", watermark)
        .where(F.col("__at").isNotNull())
        .select(text.alias(_KEY), F.col(row_id).alias(_ROW),
                F.floor(F.unix_micros("__at") / F.lit(unit_us)).alias(_TICK),
                F.coalesce(flags[0], F.lit(False)).alias(_FLAG), F.coalesce(flags[1], F.lit(False)).alias(_FLAG2))
    )
    row_type = stream.schema[row_id].dataType
    out = T.StructType().add(_KEY, "string").add(_ROW, row_type).add(_RESULT, result_type)
    processor = _Sequential(to_arrow_type(row_type), start, step, keep_ms, unit_us, flagged_first, late, wait)
    result = timed.groupBy(_KEY).transformWithStateInPandas(processor, out, "Append", "EventTime")
    own = F.when(F.col(_KEY) != "", F.substring(_KEY, 2, 1 << 30)).cast(stream.schema[key].dataType)
    return result.select(own.alias(key), F.col(_ROW).alias(row_id), F.col(_RESULT).alias(name))


def stream_rate_limit(
    stream: DataFrame,
    key: str,
    ts: str,
    row_id: str,
    everything: Bucket = ALL_REQUESTS,
    mutations: Bucket | None = None,
    is_mutation: Column | None = None,
    watermark: str = "1 minute",
    wait: bool = False,
) -> DataFrame:
    """``allowed`` per request, as ``access.rate_limit`` gives it for the same requests in a table.

    Requests without a key are not limited; they pass by without state. A late request gets null.
    """

    def step(state: tuple, tick: int, mutation: bool, _: bool) -> tuple[tuple, bool]:
        buckets = LeakyBuckets(everything, mutations)
        buckets.state = None if state[1] is None else state
        allowed = buckets.admit(tick, mutation)
        return buckets.state or state, allowed

    keep = max(b.drain_ms() for b in (everything, mutations) if b)
    flags = (is_mutation if is_mutation is not None else F.lit(False), F.lit(False))
    limited = _keyed(stream.where(F.col(key).isNotNull()), key, ts, row_id, flags, watermark, "allowed", T.BooleanType(),
                     (0, None, 0, None), step, keep, unit_us=1000, wait=wait)
    free = stream.where(F.col(key).isNull()).select(key, row_id, F.lit(True).alias("allowed"))
    return limited.unionByName(free)


def stream_flow_state(
    stream: DataFrame,
    flow: str,
    ts: str,
    row_id: str,
    started: Column,
    submitted: Column,
    lifetime_seconds: int = CODE_LIFETIME_SECONDS,
    max_submissions: int = MAX_SUBMISSIONS,
    watermark: str = "1 minute",
    wait: bool = False,
) -> DataFrame:
    """State each submission finds its flow in: ``none``, ``expired``, ``exhausted`` or ``open``.

    A flow is two numbers and is never forgotten, so that it reads ``expired`` for ever, as in the table. Every late row
    is reported as ``late``, a late start too.
    """
    lifetime = lifetime_seconds * 1_000_000

    def step(state: tuple, tick: int, is_start: bool, is_submission: bool) -> tuple[tuple, str | None]:
        at, tried = state
        if is_start:
            return (tick, 0), None
        if not is_submission:
            return state, None
        tried = (tried or 0) + 1
        if at is None:
            return (at, tried), "none"
        verdict = "expired" if tick > at + lifetime else "exhausted" if tried > max_submissions else "open"
        return (at, tried), verdict

    result = _keyed(stream, flow, ts, row_id, (started, submitted), watermark, "state", T.StringType(),
                    (None, None), step, None, flagged_first=True, late="late", wait=wait)
    return result.where(F.col("state").isNotNull())


def stream_session_state(
    stream: DataFrame,
    user: str,
    ts: str,
    row_id: str,
    login: Column,
    logout: Column,
    lifetime_seconds: int = SESSION_LIFETIME_SECONDS,
    watermark: str = "1 minute",
    wait: bool = False,
) -> DataFrame:
    """``active`` per row: a session lives a fixed time from login and a logout ends it at once. A late row gets null."""
    lifetime = lifetime_seconds * 1_000_000

    def step(state: tuple, tick: int, is_login: bool, is_logout: bool) -> tuple[tuple, bool]:
        at = state[0]
        if is_login:
            at = tick
        elif is_logout:
            at = None
        return (at,), at is not None and tick < at + lifetime

    return _keyed(stream, user, ts, row_id, (login, logout), watermark, "active", T.BooleanType(),
                  (None,), step, lifetime_seconds * 1000, wait=wait)
