"""Ordered named rules over a table, evaluated in one projection."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Rule:
    """``ok`` must hold; a null outcome counts as broken. ``value`` is what to show when it is."""

    name: str
    ok: Column
    value: Column | None = None

    def broken(self) -> Column:
        return ~F.coalesce(self.ok, F.lit(False))


_VIOLATION = "__violation"


def any_broken(rules: Sequence[Rule]) -> Column:
    return reduce(lambda a, b: a | b, [rule.broken() for rule in rules])


def check(df: DataFrame, rules: Sequence[Rule], key: Sequence[str]) -> DataFrame:
    """One row per broken rule: key columns, ``rule``, ``ordinal``, ``value``.

    No shuffle, and each rule is evaluated once: a filter ahead of the projection would be cheaper only
    for rules that cost nothing.
    """
    entries = [
        F.when(
            rule.broken(),
            F.struct(
                F.lit(rule.name).alias("rule"),
                F.lit(ordinal).cast("bigint").alias("ordinal"),
                (F.lit(None) if rule.value is None else rule.value).cast("string").alias("value"),
            ),
        )
        for ordinal, rule in enumerate(rules, start=1)
    ]
    each = df.select(*key, F.explode(F.array(*entries)).alias(_VIOLATION))
    return each.where(F.col(_VIOLATION).isNotNull()).select(*key, f"{_VIOLATION}.*")


def first_failure(df: DataFrame, rules: Sequence[Rule], name: str = "first_failure") -> DataFrame:
    """Add the name of the first broken rule, null when every rule holds."""
    return df.withColumn(name, F.coalesce(*[F.when(r.broken(), F.lit(r.name)) for r in rules]))


def split_valid(df: DataFrame, rules: Sequence[Rule]) -> tuple[DataFrame, DataFrame]:
    """Accepted rows unchanged, and quarantined rows with the list of rules they broke (``broken_rules``)."""
    names = F.array_compact(F.array(*[F.when(r.broken(), F.lit(r.name)) for r in rules]))
    return df.where(~any_broken(rules)), df.where(any_broken(rules)).withColumn("broken_rules", names)
