"""Requests, ownership, one-time codes, sessions and request rates."""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from attest.functions.columns import ColumnLike, as_column, first_of
from attest.functions.network import in_cidr
from attest.operators.skew import SLICE_ROWS, OrderedScan, lookup_join
from attest.session import ship_with_plans

ship_with_plans(__name__)

# How long a code or flow lives, how often it may be tried, how long a session lasts.
CODE_LIFETIME_SECONDS = 600
MAX_SUBMISSIONS = 5
SESSION_LIFETIME_SECONDS = 720 * 3600


def route(
    df: DataFrame,
    source: ColumnLike,
    host: ColumnLike,
    path: ColumnLike,
    cidrs: Sequence[str],
    hostname: str,
    prefix: str = "/api",
) -> DataFrame:
    """Add ``status`` and ``forward_path``: source and host are refused with 403, other paths with 404.

    What passes is forwarded with the prefix taken off once.
    """
    h, p = F.lower(as_column(host)), as_column(path)
    host_ok = F.coalesce(h.isin(hostname.lower(), f"{hostname.lower()}:443"), F.lit(False))
    at_root, below = p == prefix, F.startswith(p, F.lit(f"{prefix}/"))
    path_ok = F.coalesce(at_root | below, F.lit(False))
    status = (
        F.when(~in_cidr(source, cidrs), F.lit(403))
        .when(~host_ok, F.lit(403))
        .when(~path_ok, F.lit(404))
        .otherwise(F.lit(200))
        .cast("bigint")
    )
    rest = F.when(at_root, F.lit("/")).otherwise(F.substring(p, F.lit(len(prefix) + 1), F.length(p)))
    return df.withColumn("status", status).withColumn("forward_path", F.when(F.col("status") == 200, rest))


def match_route(path: ColumnLike, exact: Mapping[str, str], prefixes: Mapping[str, str]) -> Column:
    """Backend of a path: an exact route first, else the longest prefix. The route table is configuration."""
    p = as_column(path)
    cases = [(p == route, backend) for route, backend in exact.items()]
    by_length = sorted(prefixes.items(), key=lambda item: -len(item[0]))
    cases += [(p.startswith(prefix), backend) for prefix, backend in by_length]
    return first_of(*cases)


def owned(df: DataFrame, owner: str, value: object) -> DataFrame:
    """Rows of one owner."""
    return df.where(F.col(owner) == F.lit(value))


def lookup_owned(
    df: DataFrame, requests: DataFrame, row_id: str, owner: str, columns: Sequence[str],
    slice_rows: int | None = SLICE_ROWS,
) -> DataFrame:
    """Answer requests for rows by id and owner: someone else's row and a missing row look the same."""
    visible = df.select(row_id, owner, *columns, F.lit(True).alias("found"))
    joined = lookup_join(requests, visible, [row_id, owner], slice_rows=slice_rows)
    return joined.withColumn("found", F.coalesce("found", F.lit(False)))


def latest_unseen(
    messages: DataFrame, seen: DataFrame, message_id: str, recipients: str, position: ColumnLike, columns: Sequence[str]
) -> DataFrame:
    """Per recipient, the first message (by ``position``) that was not seen before."""
    fresh = messages.join(seen.select(message_id).distinct(), message_id, "left_anti")
    each = fresh.withColumn("recipient", F.explode(recipients))
    picked = F.min_by(F.struct(message_id, *columns), as_column(position))
    return each.groupBy("recipient").agg(picked.alias("m")).select("recipient", "m.*")


def _timeline(issued: DataFrame, submitted: DataFrame, flow: str, ts: str, row_id: str, code: str,
              slice_rows: int) -> DataFrame:
    """Submissions with the newest issue at or before them; an issue precedes a submission at the same time."""
    columns = [flow, ts, row_id, code]
    both = (
        issued.select(*columns).withColumn("__kind", F.lit(0))
        .unionByName(submitted.select(*columns).withColumn("__kind", F.lit(1)))
    )
    is_issue = F.col("__kind") == 0
    scan = OrderedScan(both, [flow], [ts, "__kind", row_id], slice_rows)
    scan = scan.running(total={"__tried": F.col("__kind")})
    scan = scan.running(
        last={"__issue": F.when(is_issue, F.struct(F.col(ts).alias("at"), F.col(code).alias("code"), "__tried"))}
    )
    return (
        scan.result()
        .where(~is_issue)
        .withColumn("attempt", F.col("__tried") - F.col("__issue.__tried"))
        .drop("__kind", "__tried")
    )


def _alive(ts: str, lifetime_seconds: int) -> Column:
    until = F.col("__issue.at") + F.make_dt_interval(secs=F.lit(lifetime_seconds))
    return F.col(ts) <= until


def code_outcomes(
    issued: DataFrame,
    submitted: DataFrame,
    flow: str,
    ts: str,
    row_id: str,
    code: str,
    lifetime_seconds: int = CODE_LIFETIME_SECONDS,
    max_submissions: int = MAX_SUBMISSIONS,
    slice_rows: int = SLICE_ROWS,
) -> DataFrame:
    """As-of join of each submission with the newest code of its flow.

    ``outcome``: ``no_code``, ``expired``, ``too_many``, ``wrong_code`` (also an older code after a
    resend) or ``accepted``; ``attempt`` counts submissions since that code was issued.
    """
    rows = _timeline(issued, submitted, flow, ts, row_id, code, slice_rows)
    outcome = first_of(
        (F.col("__issue").isNull(), "no_code"),
        (~_alive(ts, lifetime_seconds), "expired"),
        (F.col("attempt") > max_submissions, "too_many"),
        (~F.col(code).eqNullSafe(F.col("__issue.code")), "wrong_code"),
        otherwise=F.lit("accepted"),
    )
    return rows.withColumn("outcome", outcome).drop("__issue")


def flow_state(
    started: DataFrame,
    submitted: DataFrame,
    flow: str,
    ts: str,
    row_id: str,
    lifetime_seconds: int = CODE_LIFETIME_SECONDS,
    max_submissions: int = MAX_SUBMISSIONS,
    slice_rows: int = SLICE_ROWS,
) -> DataFrame:
    """State a submission finds its flow in: ``none``, ``expired``, ``exhausted`` or ``open``."""
    blank = F.lit(None).cast("string")
    rows = _timeline(started.withColumn("__code", blank), submitted.withColumn("__code", blank),
                     flow, ts, row_id, "__code", slice_rows)
    state = first_of(
        (F.col("__issue").isNull(), "none"),
        (~_alive(ts, lifetime_seconds), "expired"),
        (F.col("attempt") > max_submissions, "exhausted"),
        otherwise=F.lit("open"),
    )
    return rows.withColumn("state", state).drop("__issue", "__code")


def session_state(
    df: DataFrame,
    user: str,
    ts: str,
    row_id: str,
    login: Column,
    logout: Column,
    lifetime_seconds: int = SESSION_LIFETIME_SECONDS,
    slice_rows: int = SLICE_ROWS,
) -> DataFrame:
    """Add ``active``: whether the user has a session at each row.

    A session lives a fixed time from login, activity does not extend it, and a logout ends it at once.
    """
    mark = F.when(login | logout, F.struct(login.alias("is_login"), F.col(ts).alias("at")))
    scan = OrderedScan(df, [user], [ts, row_id], slice_rows).running(last={"__mark": mark})
    until = F.col("__mark.at") + F.make_dt_interval(secs=F.lit(lifetime_seconds))
    active = F.coalesce(F.col("__mark.is_login") & (F.col(ts) < until), F.lit(False))
    return scan.result().withColumn("active", active).drop("__mark")


@dataclass(frozen=True)
class Bucket:
    """``limit`` requests per ``period_ms`` with ``burst`` more held at once, counted in thousandths."""

    limit: int
    period_ms: int
    burst: int

    @property
    def capacity(self) -> int:
        return self.burst * 1000

    def drain_ms(self) -> int:
        """After this long without requests the bucket is as good as new."""
        return -(-(self.burst + 1) * self.period_ms // self.limit)

    def fill(self, excess: int, elapsed_ms: int) -> int:
        return max(0, excess - self.limit * 1000 * elapsed_ms // self.period_ms + 1000)


# The request budget of a client, and the stricter one of its mutations.
ALL_REQUESTS = Bucket(limit=60, period_ms=60_000, burst=20)
MUTATIONS = Bucket(limit=10, period_ms=60_000, burst=5)


class LeakyBuckets:
    """Two leaky buckets sharing one verdict; a refused request adds load to neither."""

    def __init__(self, everything: Bucket, mutations: Bucket | None):
        self.everything, self.mutations = everything, mutations
        self.state: tuple[int, int, int, int] | None = None  # excess, last, mutation excess, mutation last

    def admit(self, tick: int, mutation: bool) -> bool:
        excess, last, m_excess, m_last = self.state or (0, None, 0, None)
        new = 0 if last is None else self.everything.fill(excess, tick - last)
        if new > self.everything.capacity:
            return False
        if mutation and self.mutations is not None:
            m_new = 0 if m_last is None else self.mutations.fill(m_excess, tick - m_last)
            if m_new > self.mutations.capacity:
                return False
            m_excess, m_last = m_new, tick
        self.state = (new, tick, m_excess, m_last)
        return True


#: Requests of one run that are folded in one piece, about.
FOLD_ROWS = 2_000_000
#: Start levels that a slice is followed from, at most; a finer budget is folded in one piece.
MOST_LEVELS = 2_000_000


class Level:
    """How full a bucket is, in whole numbers, so that draining for any time is one subtraction.

    A level is the excess times ``unit`` less ``rate`` for each millisecond since it was set; ``empty`` stands for all
    levels that the next request finds drained.
    """

    def __init__(self, bucket: Bucket):
        common = math.gcd(bucket.limit * 1000, bucket.period_ms)
        self.rate, self.unit = bucket.limit * 1000 // common, bucket.period_ms // common
        self.empty, self.full = -1000 * self.unit, bucket.capacity * self.unit
        self.most = self.full - 1000 * self.unit

    def count(self) -> int:
        return self.full - self.empty + 1

    def drained(self, level, elapsed_ms: int):
        return np.maximum(level - self.rate * elapsed_ms, self.empty)

    def loaded(self, level):
        """The level after a request that is admitted."""
        return (-(-level // self.unit) + 1000) * self.unit


def rate_limit(
    df: DataFrame,
    key: str,
    ts: str,
    row_id: str,
    everything: Bucket = ALL_REQUESTS,
    mutations: Bucket | None = None,
    is_mutation: Column | None = None,
    slice_rows: int = SLICE_ROWS,
    fold_rows: int = FOLD_ROWS,
) -> DataFrame:
    """Add ``allowed``: the verdict of the leaky buckets per request, in order of time and ``row_id``.

    ``row_id`` must be unique; requests without a key are not limited.

    The fold is sequential per client, so only what can change its state reaches it:

    * time is cut in cells as long as a full bucket takes to drain; an empty cell resets the client, and
      runs of occupied cells are independent of each other;
    * a run with no more requests than one burst is admitted whole, without a fold;
    * within one millisecond at most ``burst + 1`` requests of a kind can pass, so later ones are refused
      without being folded (Spark applies this per-group limit before the shuffle);
    * a run of more than ``fold_rows`` requests is cut into slices, where a cell without mutations has drained the
      second bucket. Each slice is a function of the level it starts at: slices are folded side by side from every
      level at once, the functions of a run are applied one after another, one step a slice, and then each slice is
      folded again from the level it really starts at.

    The cells of a run are numbered in one task; a run whose client sends mutations in every cell stays in one piece.
    """
    mutation = F.coalesce(is_mutation, F.lit(False)) if is_mutation is not None and mutations else F.lit(False)
    buckets = [everything, *([mutations] if mutations else [])]
    cell_ms = max(b.drain_ms() for b in buckets)
    tick = F.unix_millis(F.col(ts).cast("timestamp"))
    rows = df.withColumns({"__tick": tick, "__cell": F.floor(tick / F.lit(cell_ms)), "__mutation": mutation})
    most = everything.burst + 1
    limit = F.when(F.col("__mutation"), min(b.burst for b in buckets) + 1).otherwise(most)
    rank = F.row_number().over(Window.partitionBy(key, "__tick", "__mutation").orderBy(row_id))
    id_type = df.schema[row_id].dataType.simpleString()

    def candidates(tagged: DataFrame, *columns: str) -> DataFrame:
        """What may pass: no more requests of a millisecond than its burst."""
        some = tagged.select(key, *columns, "__tick", row_id, "__mutation").withColumn("__rank", rank)
        return some.where(F.col("__rank") <= most).where(F.col("__rank") <= limit).drop("__rank")

    def judged(tagged: DataFrame, verdicts: DataFrame) -> DataFrame:
        return tagged.join(verdicts, row_id, "left").select(*df.columns, F.coalesce("__ok", F.lit(False)).alias("allowed"))

    islands = _islands(rows, key, everything, mutations, fold_rows if Level(everything).count() <= MOST_LEVELS else None)
    busy = islands.select(key, "__cell", "__island", "__sliced")
    tagged = lookup_join(rows, busy, [key, "__cell"], slice_rows=slice_rows, distinct_by=[row_id])
    whole = tagged.where(F.col("__island").isNotNull() & ~F.col("__sliced"))
    in_order = candidates(whole, "__island").repartition(key, "__island").sortWithinPartitions(key, "__island", "__tick", row_id)
    verdicts = in_order.mapInPandas(_fold(key, row_id, everything, mutations), f"`{row_id}` {id_type}, __ok boolean")
    quiet = tagged.where(F.col("__island").isNull()).select(*df.columns, F.lit(True).alias("allowed"))
    result = quiet.unionByName(judged(whole, verdicts))
    if Level(everything).count() > MOST_LEVELS:
        return result

    # One row for each slice of at least ``fold_rows`` requests, so it is broadcast; without any this part reads nothing.
    of = F.col(key).alias("__of")
    slices = islands.where("__sliced").groupBy(of, "__island", "__slice").agg(F.min("__cell").alias("__from"), F.max("__cell").alias("__to"))
    sliced = rows.join(F.broadcast(slices), (rows[key] == F.col("__of")) & F.col("__cell").between(F.col("__from"), F.col("__to")))
    some = candidates(sliced, "__island", "__slice")
    group = [key, "__island", "__slice"]
    key_type = df.schema[key].dataType.simpleString()
    names = f"`{key}` {key_type}, __island long, __slice long"
    followed = some.repartition(*group).sortWithinPartitions(*group, "__tick", row_id).mapInPandas(
        _functions(key, everything, mutations), f"{names}, first long, last long, levels binary")
    starts = followed.repartition(key, "__island").sortWithinPartitions(*group).mapInPandas(_starts(key, everything), f"{names}, __level long")
    starts = starts.withColumnsRenamed({key: "__k", "__island": "__i", "__slice": "__s"})
    same = (some[key] == starts["__k"]) & (some["__island"] == starts["__i"]) & (some["__slice"] == starts["__s"])
    known = some.join(F.broadcast(starts), same).drop("__k", "__i", "__s")
    again = known.repartition(*group).sortWithinPartitions(*group, "__tick", row_id).mapInPandas(
        _refold(key, row_id, everything, mutations), f"`{row_id}` {id_type}, __ok boolean")
    return result.unionByName(judged(sliced, again))


def _islands(rows: DataFrame, key: str, everything: Bucket, mutations: Bucket | None, fold_rows: int | None) -> DataFrame:
    """``key, __cell, __island, __slice, __sliced``: the cells of runs that need a fold, and the slices of long runs."""
    cells = rows.groupBy(key, "__cell").agg(F.count(F.lit(1)).alias("__n"), F.count_if(F.col("__mutation")).alias("__m"))
    ordered = Window.partitionBy(key).orderBy("__cell")
    starts = F.when(F.coalesce(F.col("__cell") - F.lag("__cell").over(ordered) > 1, F.lit(True)), F.col("__cell"))
    islands = cells.withColumn("__start", starts).withColumn("__island", F.last("__start", ignorenulls=True).over(ordered))
    whole = Window.partitionBy(key, "__island")
    crowded = F.sum("__n").over(whole) > everything.burst + 1
    if mutations:
        crowded = crowded | (F.sum("__m").over(whole) > mutations.burst + 1)
    if fold_rows is None:
        return islands.withColumn("__busy", crowded).where("__busy").withColumns({"__slice": F.lit(0).cast("long"), "__sliced": F.lit(False)})
    inside = whole.orderBy("__cell")
    before = F.coalesce(F.sum("__n").over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    # A slice may start after a cell without mutations: the second bucket has drained.
    free = F.coalesce(F.lag("__m").over(inside), F.lit(0)) == 0
    marked = islands.withColumns({"__busy": crowded, "__mark": F.when(free, F.floor(before / fold_rows))})
    marked = marked.withColumn("__slice", F.max("__mark").over(inside))
    return marked.withColumn("__sliced", F.max("__slice").over(whole) > 0).where("__busy")


def _runs(batches: Iterator[pd.DataFrame], group: list[str], *columns: str) -> Iterator[tuple[pd.DataFrame, list[tuple]]]:
    """Of each batch its frame and its parts: (group, whether it is new, the columns' values from where to where)."""
    current = None
    for pdf in batches:
        keys = list(zip(*[pdf[g].tolist() for g in group]))
        values = [pdf[c].tolist() for c in columns]
        parts, at = [], 0
        while at < len(keys):
            end = at + 1
            while end < len(keys) and keys[end] == keys[at]:
                end += 1
            parts.append((keys[at], keys[at] != current, [v[at:end] for v in values]))
            current, at = keys[at], end
        yield pdf, parts


def _functions(key: str, everything: Bucket, mutations: Bucket | None):
    """Where each slice ends, for every level it may start at; levels that have met go on as one."""
    group = [key, "__island", "__slice"]

    def follow(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        main, other = Level(everything), Level(mutations) if mutations else None
        held = None

        def done() -> pd.DataFrame:
            name, first, last, level, _, of = held
            return pd.DataFrame([[*name, first, last, zlib.compress(level[of].astype("<i8").tobytes(), 1)]], columns=[*group, "first", "last", "levels"])

        for _, parts in _runs(batches, group, "__tick", "__mutation"):
            for name, new, (ticks, kinds) in parts:
                if new:
                    if held:
                        yield done()
                    level = np.arange(main.empty, main.full + 1)
                    held = [name, ticks[0], ticks[0], level, np.full(len(level), other.empty) if other else None, np.arange(len(level))]
                _, _, last, level, second, of = held
                for i, (tick, mutation) in enumerate(zip(ticks, kinds)):
                    if tick > last:
                        level = main.drained(level, tick - last)
                        second = other.drained(second, tick - last) if other else None
                        last = tick
                    passes = level <= main.most
                    if mutation and other:
                        passes &= second <= other.most
                        second = np.where(passes, other.loaded(second), second)
                    level = np.where(passes, main.loaded(level), level)
                    if i % 32 == 31 and len(level) > 1:
                        both = np.stack([level, second if other else level])
                        kept, inverse = np.unique(both, axis=1, return_inverse=True)
                        level, second, of = kept[0], kept[1] if other else None, inverse.ravel()[of]
                held[2:] = [last, level, second, of]
        if held:
            yield done()

    return follow


def _starts(key: str, everything: Bucket):
    """The level each slice starts at: a run's first slice finds an empty bucket."""
    group = [key, "__island", "__slice"]

    def chain(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        main = Level(everything)
        run, level, last = None, main.empty, 0
        for pdf in batches:
            levels = []
            for k, island, first, end, packed in zip(pdf[key].tolist(), pdf["__island"].tolist(), pdf["first"].tolist(), pdf["last"].tolist(), pdf["levels"].tolist()):
                if (k, island) != run:
                    run, level, last = (k, island), main.empty, first
                level = int(main.drained(level, first - last))
                levels.append(level)
                level, last = int(np.frombuffer(zlib.decompress(packed), "<i8")[level - main.empty]), end
            yield pd.DataFrame({**{g: pdf[g] for g in group}, "__level": levels})

    return chain


def _refold(key: str, row_id: str, everything: Bucket, mutations: Bucket | None):
    """The verdicts of each slice from the level it starts at."""

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        main, other = Level(everything), Level(mutations) if mutations else None
        level, second, last = main.empty, 0, 0
        for pdf, parts in _runs(batches, [key, "__island", "__slice"], "__tick", "__mutation", "__level"):
            verdicts = []
            for _, new, (ticks, kinds, starts) in parts:
                if new:
                    level, second, last = starts[0], other.empty if other else 0, ticks[0]
                for tick, mutation in zip(ticks, kinds):
                    if tick > last:
                        level = max(level - main.rate * (tick - last), main.empty)
                        second = max(second - other.rate * (tick - last), other.empty) if other else 0
                        last = tick
                    passes = level <= main.most and not (mutation and other and second > other.most)
                    if passes:
                        level = main.loaded(level)
                        if mutation and other:
                            second = other.loaded(second)
                    verdicts.append(passes)
            yield pd.DataFrame({row_id: pdf[row_id], "__ok": verdicts})

    return fold


def _fold(key: str, row_id: str, everything: Bucket, mutations: Bucket | None):
    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, buckets = None, None
        for pdf in batches:
            verdicts = []
            for k, island, tick, mutation in zip(
                pdf[key].tolist(), pdf["__island"].tolist(), pdf["__tick"].tolist(), pdf["__mutation"].tolist()
            ):
                if (k, island) != current:
                    current, buckets = (k, island), LeakyBuckets(everything, mutations)
                verdicts.append(buckets.admit(tick, mutation))
            yield pd.DataFrame({row_id: pdf[row_id], "__ok": verdicts})

    return fold


def request_counts(
    df: DataFrame, key: str, ts: str, width: str, budget: int, watermark: str | None = None
) -> DataFrame:
    """Requests per client and tumbling window, and whether they exceed the budget. Works on streams too.

    Counting combines map-side, so a client with very many requests is a handful of partial counts.
    """
    timed = df.withColumn("__at", F.col(ts).cast("timestamp"))
    if df.isStreaming:
        timed = timed.withWatermark("__at", watermark or width)
    counts = timed.groupBy(key, F.window("__at", width).alias("w")).agg(F.count(F.lit(1)).alias("n_requests"))
    return counts.select(
        key,
        F.unix_seconds("w.start").alias("window_start"),
        "n_requests",
        (F.col("n_requests") > budget).alias("breach"),
    )
