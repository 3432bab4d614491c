"""Joins and ordered windows that survive a key holding a large share of all rows.

Spark splits a skewed shuffle join at run time, but not when an aggregate sits under the join, and it never splits a
window partition. A thin sample of the key columns tells which keys have more than ``slice_rows`` rows, and how many
slices those need:

* ``lookup_join`` spreads a key's rows over its slices and repeats its single lookup row per slice. It is one plan,
  with or without such keys, and nothing runs while it is built;
* ``OrderedScan`` cuts a hot key's ordered rows into slices with a range partitioning, scans each slice
  alone, and carries the slices' summaries across;
* ``numbered`` numbers a whole table by ranges and offsets, whatever its size.

The sample decides sizes only. Results are exact for any set of hot keys and any slices: a key the sample
misses, or one that shares a hash with a hot key, takes a path that gives the same rows.

What is broadcast is the list of hot keys and one summary per slice: a key is hot from ``slice_rows`` rows on, so both
have at most about one narrow row for each ``slice_rows`` rows (at two million, 8 MB for 10^12 rows). No key is left out.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from attest.session import written

SLICE_ROWS = 2_000_000
SAMPLES_PER_SLICE = 64
SEED = 7

_KEY = "__key"
_ROWS = "__rows"
_SLICES = "__slices"
_SLICE = "__slice"
_PIECE = "__piece"
_CARRY = "__carry_"
_WHOLE = -1


def hot_keys(df: DataFrame, by: Sequence[str], slice_rows: int = SLICE_ROWS) -> DataFrame:
    """Hashes of the keys with more than ``slice_rows`` rows, and their slices: ``__key, __rows, __slices``.

    Only key columns are read, and only a sample of about ``SAMPLES_PER_SLICE`` rows per ``slice_rows`` is shuffled.
    """
    share = min(1.0, SAMPLES_PER_SLICE / slice_rows)
    keys = df.select(F.xxhash64(*by).alias(_KEY))
    sampled = keys if share == 1.0 else keys.sample(False, share, SEED)
    counts = sampled.groupBy(_KEY).agg(F.count(F.lit(1)).alias(_ROWS)).where(F.col(_ROWS) > slice_rows * share)
    rows = F.ceil(F.col(_ROWS) / share)
    return counts.select(_KEY, rows.alias(_ROWS), F.ceil(rows / slice_rows).cast("int").alias(_SLICES))


def _tag(df: DataFrame, by: Sequence[str], tags: DataFrame, how: str = "left") -> DataFrame:
    """Attach facts about hot keys, of which there are few (see above), so they are broadcast."""
    return df.join(F.broadcast(tags), F.xxhash64(*[df[k] for k in by]) == tags[_KEY], how).drop(_KEY)


def lookup_join(
    rows: DataFrame,
    table: DataFrame,
    on: Sequence[str],
    how: str = "left",
    slice_rows: int | None = SLICE_ROWS,
    distinct_by: Sequence[str] | None = None,
    sized_by: DataFrame | None = None,
) -> DataFrame:
    """Join rows to a table with at most one row per key (many to one); ``how`` is left, inner or left_semi.

    ``distinct_by`` names columns that tell all rows of a key apart; without it all columns do, and copies of a row
    share a slice, which Spark's own splitting of skewed joins cuts further. ``sized_by`` is a cheaper table with the
    same keys to sample. ``slice_rows=None`` is the plain join, where keys are known to be distinct.
    """
    on = list(on)
    if slice_rows is None:
        return rows.join(table, on, how)
    # Both sides read one and the same broadcast.
    hot = hot_keys(rows if sized_by is None else sized_by, on, slice_rows).select(_KEY, _SLICES)
    slices = F.coalesce(F.col(_SLICES), F.lit(1))
    right = _tag(table, on, hot).withColumn(_SLICE, F.explode(F.sequence(F.lit(0), slices - 1))).drop(_SLICES)
    comparable = [f.name for f in rows.schema.fields if not isinstance(f.dataType, (T.MapType, T.VariantType))]
    spread = F.pmod(F.xxhash64(*(distinct_by or comparable)), slices).cast("int")
    left = _tag(rows, on, hot).withColumn(_SLICE, spread).drop(_SLICES)
    return left.join(right, [*on, _SLICE], how).drop(_SLICE)


def numbered(df: DataFrame, order: Sequence[str], name: str) -> DataFrame:
    """Position (from 1) of each row in the whole table's order, which must be total.

    Rows are range-partitioned, sorted and numbered inside their range, and written once, so that every use sees the
    same ranges; the ranges' sizes give the offsets, one row per range.
    """
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn(_ROWS, F.monotonically_increasing_id())
    rows = written(ranged, "numbered")
    piece, place = F.shiftright(_ROWS, 33).alias(_PIECE), F.col(_ROWS).bitwiseAND(F.lit((1 << 33) - 1))
    sizes = rows.groupBy(piece).agg(F.count(F.lit(1)).alias(_SLICES))
    before = Window.orderBy(_PIECE).rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(_PIECE, F.coalesce(F.sum(_SLICES).over(before), F.lit(0)).alias(_CARRY))
    joined = rows.withColumn(_PIECE, piece).join(F.broadcast(offsets), _PIECE)
    return joined.withColumn(name, place + F.col(_CARRY) + 1).drop(_PIECE, _ROWS, _CARRY)


class OrderedScan:
    """Running values over rows of each key in order, safe for keys of any size.

    ``order`` must put the rows of a key in one total order (end it with a unique column).
    """

    def __init__(self, df: DataFrame, by: Sequence[str], order: Sequence[str], slice_rows: int = SLICE_ROWS):
        self.by, self.order = list(by), list(order)
        hot = hot_keys(df, self.by, slice_rows)
        slices = hot.agg(F.sum(_SLICES)).first()[0]
        self.sliced = slices is not None
        self.rows = self._sliced(df, hot, int(slices)) if self.sliced else df

    def running(
        self,
        *,
        last: Mapping[str, Column] | None = None,
        total: Mapping[str, Column] | None = None,
        inclusive: bool = True,
    ) -> "OrderedScan":
        """Add columns: the last non-null value, or the sum of a number, up to each row (or before it)."""
        last, total = dict(last or {}), dict(total or {})
        keys = [*self.by, _SLICE] if self.sliced else self.by
        end = Window.currentRow if inclusive else -1
        window = Window.partitionBy(*keys).orderBy(*self.order).rowsBetween(Window.unboundedPreceding, end)
        local = {n: F.last(c, ignorenulls=True).over(window) for n, c in last.items()}
        local |= {n: F.coalesce(F.sum(c).over(window), F.lit(0)).cast("bigint") for n, c in total.items()}
        scanned = self.rows.select("*", *[c.alias(n) for n, c in local.items()])
        if self.sliced:
            scanned = self._carried(scanned, last, total)
        result = object.__new__(OrderedScan)
        result.by, result.order, result.sliced, result.rows = self.by, self.order, self.sliced, scanned
        return result

    def result(self) -> DataFrame:
        return self.rows.drop(_SLICE)

    def _sliced(self, df: DataFrame, hot: DataFrame, slices: int) -> DataFrame:
        """Cut the rows of hot keys into ordered slices with a range partitioning; others stay whole.

        The cut depends on what the partitioning samples, so the rows are written once with their slice and
        every later use, also after the loss of an executor, sees the same one.
        """
        hot = written(hot, "hot")
        tagged = _tag(df, self.by, hot.drop(_ROWS))
        cold = tagged.where(F.col(_SLICES).isNull()).drop(_SLICES).withColumn(_SLICE, F.lit(_WHOLE))
        ranged = (
            _tag(df, self.by, hot.select(_KEY), "left_semi")
            .repartitionByRange(slices, *self.by, *self.order)
            .withColumn(_SLICE, F.spark_partition_id())
        )
        return cold.unionByName(written(ranged, "slices"))

    def _carried(self, scanned: DataFrame, last: Mapping[str, Column], total: Mapping[str, Column]) -> DataFrame:
        """Add what the slices before a row's own contribute."""
        position = F.struct(*self.order)
        summaries = [F.max_by(c, F.when(c.isNotNull(), position)).alias(n) for n, c in last.items()]
        summaries += [F.sum(c).alias(n) for n, c in total.items()]
        per_slice = self.rows.where(F.col(_SLICE) != _WHOLE).groupBy(*self.by, _SLICE).agg(*summaries)
        before = Window.partitionBy(*self.by).orderBy(_SLICE).rowsBetween(Window.unboundedPreceding, -1)
        carried = [F.last(n, ignorenulls=True).over(before).alias(_CARRY + n) for n in last]
        carried += [F.sum(n).over(before).alias(_CARRY + n) for n in total]
        keys = [*self.by, _SLICE]
        # One row per hot key and slice, see above, so it is broadcast.
        carry = per_slice.select(*[F.col(k).alias(_CARRY + "key_" + k) for k in keys], *carried)
        same = F.lit(True)
        for k in keys:
            same = same & F.col(k).eqNullSafe(F.col(_CARRY + "key_" + k))
        joined = scanned.join(F.broadcast(carry), same, "left")
        updates = {n: F.coalesce(F.col(n), F.col(_CARRY + n)) for n in last}
        updates |= {n: F.col(n) + F.coalesce(F.col(_CARRY + n), F.lit(0)) for n in total}
        return joined.withColumns(updates).drop(*[c for c in joined.columns if c.startswith(_CARRY)])


def with_ordinal(df: DataFrame, by: Sequence[str], order: Sequence[str], name: str = "ordinal",
                 slice_rows: int = SLICE_ROWS) -> DataFrame:
    """Position (from 1) of each row within its key."""
    return OrderedScan(df, by, order, slice_rows).running(total={name: F.lit(1)}).result()
