"""Rules about whole groups, and set operations."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attest.functions.columns import ColumnLike, as_column
from attest.functions.predicates import MAX_FILE_BYTES
from attest.operators.skew import numbered


def group_rules(
    df: DataFrame,
    by: Sequence[str],
    *,
    kind: ColumnLike,
    size: ColumnLike,
    expected_kinds: Sequence[str],
    max_size: int = MAX_FILE_BYTES,
) -> DataFrame:
    """Verdict per group: exactly one row of each expected kind, whole sizes in (0, ``max_size``].

    The expected kinds are a short declared list, so they are counted as flags in the one aggregate.
    """
    k, s = as_column(kind), as_column(size)
    facts = df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_rows"),
        reduce(lambda a, b: a + b, [F.max(F.when(k == x, 1).otherwise(0)) for x in expected_kinds])
        .cast("bigint").alias("n_kinds"),
        F.bool_and(F.coalesce(k.isin(*expected_kinds), F.lit(False))).alias("kinds_known"),
        F.bool_and(F.coalesce((s > 0) & (s <= max_size) & (s == F.floor(s)), F.lit(False))).alias("sizes_ok"),
    )
    wanted = len(expected_kinds)
    return facts.withColumns({
        "count_ok": F.col("n_rows") == wanted,
        "kinds_ok": F.col("kinds_known") & (F.col("n_kinds") == F.col("n_rows")),
    }).withColumn("ok", F.col("count_ok") & F.col("kinds_ok") & F.col("sizes_ok")).drop("kinds_known")


def group_verdict(df: DataFrame, by: Sequence[str], rules: Mapping[str, Column]) -> DataFrame:
    """Evaluate named aggregate conditions per group in one pass, plus ``ok`` when all hold."""
    aggregates = [F.coalesce(c, F.lit(False)).alias(n) for n, c in rules.items()]
    verdict = df.groupBy(*by).agg(*aggregates)
    return verdict.withColumn("ok", reduce(lambda a, b: a & b, [F.col(n) for n in rules]))


def duplicates(df: DataFrame, by: Sequence[str], key: Sequence[str]) -> DataFrame:
    """Keys that occur more than once in a group, with how often."""
    return df.groupBy(*by, *key).agg(F.count(F.lit(1)).alias("n_rows")).where(F.col("n_rows") > 1)


def completeness(df: DataFrame, key: ColumnLike, expected: int | Column) -> DataFrame:
    """Whether the row count and the number of distinct keys both equal the expected number."""
    wanted = F.lit(expected) if isinstance(expected, int) else expected
    facts = df.agg(F.count(F.lit(1)).alias("n_rows"), F.countDistinct(as_column(key)).alias("n_keys"))
    return facts.withColumn("complete", (F.col("n_rows") == wanted) & (F.col("n_keys") == wanted))


def report_gate(df: DataFrame, by: Sequence[str], outcome: ColumnLike, errors: ColumnLike | None = None) -> DataFrame:
    """Pass only a report with something expected and nothing unexpected, skipped, flaky or in error."""
    o = as_column(outcome)
    error = as_column(errors) if errors is not None else o == "error"
    kinds = ("expected", "unexpected", "skipped", "flaky")
    facts = df.groupBy(*by).agg(*[F.count_if(o == k).alias(k) for k in kinds], F.count_if(error).alias("errors"))
    bad = F.col("unexpected") + F.col("skipped") + F.col("flaky") + F.col("errors")
    return facts.withColumn("passed", (F.col("expected") > 0) & (bad == 0))


def readiness(
    df: DataFrame, by: Sequence[str], check: ColumnLike, passed: ColumnLike, checks: Sequence[str]
) -> DataFrame:
    """All checks pass per group, with the names of those that fail in the declared order.

    ``checks`` is the declared list, so a group is one row of flags from a single aggregate. Failing rows of
    a check that was not declared appear as ``other``.
    """
    name, ok = as_column(check), F.coalesce(as_column(passed), F.lit(False))
    wanted = {c: name.eqNullSafe(F.lit(c)) for c in checks}
    wanted["other"] = ~F.coalesce(name.isin(*checks), F.lit(False))
    flags = {f"__{i}": F.bool_and(F.when(rows, ok)) for i, rows in enumerate(wanted.values())}
    facts = df.groupBy(*by).agg(*[c.alias(n) for n, c in flags.items()])
    seen = reduce(lambda a, b: a + b, [F.col(n).isNotNull().cast("bigint") for n in flags])
    failed = F.array_compact(F.array(*[F.when(~F.col(n), F.lit(c)) for n, c in zip(flags, wanted)]))
    return facts.select(*by, seen.alias("n_checks"), failed.alias("failures")).withColumn(
        "ready", F.size("failures") == 0
    )


def content_drift(df: DataFrame, key: Sequence[str], digest: ColumnLike) -> DataFrame:
    """Keys seen with more than one digest."""
    facts = df.groupBy(*key).agg(F.countDistinct(as_column(digest)).alias("n_digests"))
    return facts.where(F.col("n_digests") > 1)


def outcome_summary(df: DataFrame, by: Sequence[str], action: ColumnLike, actions: Sequence[str]) -> DataFrame:
    """Rows per outcome and group."""
    a = as_column(action)
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("n_rows"), *[F.count_if(a == x).alias(f"n_{x}") for x in actions])


def in_order(df: DataFrame, order: Sequence[str], name: str = "position") -> DataFrame:
    """Add each row's position (from 1) in the whole table's order; ``order`` must end with a unique column.

    The table is numbered range by range, so no single task sorts it. Sort by ``name`` to write in order.
    """
    return numbered(df, order, name)


def combine(*frames: DataFrame) -> DataFrame:
    """Concatenate batches by column name; columns missing from a batch are null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def same_rows(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows two tables do not share, with their surplus; empty when the tables are equal as multisets.

    One aggregate over both sides instead of two differences, so each side is shuffled once.
    """
    columns = a.columns
    signed = a.withColumn("__d", F.lit(1)).unionByName(b.select(*columns).withColumn("__d", F.lit(-1)))
    surplus = signed.groupBy(*columns).agg(F.sum("__d").alias("surplus"))
    return surplus.where(F.col("surplus") != 0)


def _range_digests(df: DataFrame, key: str, low: int, width: int) -> DataFrame:
    """``node, n, total, mixed`` of the rows of each key range: sums that do not depend on the rows' order."""
    columns = sorted(df.columns)
    node = F.expr(f"(CAST(`{key}` AS DECIMAL(38, 0)) - {low}) DIV {width}").alias("node")
    first, second = F.xxhash64(*columns), F.xxhash64(F.lit(1), *columns)
    return df.groupBy(node).agg(
        F.count(F.lit(1)).alias("n"), F.sum(first.cast("decimal(38,0)")).alias("total"), F.sum(second.cast("decimal(38,0)")).alias("mixed"))


def _within(key: str, ranges: Sequence[tuple[int, int]]) -> Column:
    """Whether a key lies in one of the ranges: comparisons that reach the scan."""
    return reduce(lambda a, b: a | b, [F.col(key).between(low, high) for low, high in ranges], F.lit(False))


def differing_ranges(
    a: DataFrame, b: DataFrame, key: str, fanout: int = 256, leaf_rows: int = 100_000, most_ranges: int = 512
) -> list[tuple[int, int]]:
    """Ranges of a whole-number key, ends included, outside which two tables have the same rows.

    A tree of key ranges, ``fanout`` to a node: each level compares digests of the ranges that differed above, read by
    filters on the key, and goes on until a range holds few rows or there are too many to name. Equal tables exchange
    one level of digests. A digest is two sums of 64-bit hashes.
    """
    ends = [df.agg(F.min(key).alias("low"), F.max(key).alias("high")).first() for df in (a, b)]
    ends = [(int(e["low"]), int(e["high"])) for e in ends if e["low"] is not None]
    if not ends:
        return []
    low, high = min(e[0] for e in ends), max(e[1] for e in ends)
    ranges, width = [(low, high)], high - low + 1
    while True:
        width = max(1, -(-width // fanout))
        left, right = (_range_digests(df.where(_within(key, ranges)), key, low, width) for df in (a, b))
        right = right.select(F.col("node").alias("other"), *[F.col(c).alias(f"{c}2") for c in ("n", "total", "mixed")])
        same = reduce(lambda x, y: x & y, [F.col(c).eqNullSafe(F.col(f"{c}2")) for c in ("n", "total", "mixed")])
        found = left.join(right, left["node"] == right["other"], "full").where(~same)
        found = found.select(F.coalesce("node", "other").alias("node"), F.greatest("n", "n2").alias("rows")).limit(most_ranges + 1).collect()
        if len(found) > most_ranges:
            return ranges
        ranges = []
        for node in sorted(int(r["node"]) for r in found):
            start, end = low + node * width, min(high, low + (node + 1) * width - 1)
            if ranges and ranges[-1][1] == start - 1:
                ranges[-1] = (ranges[-1][0], end)
            else:
                ranges.append((start, end))
        if width == 1 or not found or max(r["rows"] for r in found) <= leaf_rows:
            return ranges


def same_rows_by_range(a: DataFrame, b: DataFrame, key: str, **options) -> DataFrame:
    """``same_rows`` of tables that are mostly equal: only key ranges whose digests differ, and null keys, are compared row by row."""
    ranges = differing_ranges(a, b, key, **options)
    some = _within(key, ranges) | F.col(key).isNull()
    return same_rows(a.where(some), b.where(some))


def change_counts(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row: how many rows only ``a`` has, only ``b`` has, and whether the tables are equal."""
    diff = same_rows(a, b)
    return diff.agg(
        F.coalesce(F.sum(F.when(F.col("surplus") > 0, F.col("surplus"))), F.lit(0)).alias("only_left"),
        F.coalesce(F.sum(F.when(F.col("surplus") < 0, -F.col("surplus"))), F.lit(0)).alias("only_right"),
    ).withColumn("equal", (F.col("only_left") == 0) & (F.col("only_right") == 0))
