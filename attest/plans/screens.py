"""Screen inventories: per-screen rules and the evidence index."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attest.functions.columns import ColumnLike, as_column
from attest.operators.graph import dangling_edges, first_membership, match_by_suffix, uncovered
from attest.operators.rules import Rule, check
from attest.operators.sets import duplicates

# How many digits a screen's name has and how much it must be described.
ID_DIGITS = 3
MIN_DESCRIPTION = 200


def padded(index: ColumnLike, digits: int) -> Column:
    """Number with leading zeros; a longer number is kept whole."""
    text = as_column(index).cast("string")
    return F.lpad(text, F.greatest(F.lit(digits), F.length(text)), F.lit("0"))


def screen_rules(expected: int | Column, prefix: str = "", digits: int = ID_DIGITS,
                 with_edges: bool = True) -> list[Rule]:
    limit = F.lit(expected) if isinstance(expected, int) else expected
    rules = [
        Rule("index", (F.col("index") >= 0) & (F.col("index") < limit), F.col("index")),
        Rule("id", F.col("id") == F.concat(F.lit(prefix), padded("index", digits)), F.col("id")),
        Rule("description", F.char_length("description") >= MIN_DESCRIPTION, F.char_length("description")),
        *[Rule(c, F.col(c) != "", F.col(c)) for c in ("title", "summary", "category")],
        Rule("controls", F.col("controls").isNotNull()),
    ]
    if with_edges:
        edges = F.coalesce(F.col("transitions"), F.array().cast("array<struct<to:string,action:string,confidence:string>>"))
        rules += [
            Rule("confidence", F.forall(edges, lambda e: e["confidence"].eqNullSafe(F.lit("inferred")))),
            Rule("action", F.forall(edges, lambda e: F.coalesce(e["action"] != "", F.lit(False)))),
        ]
    return rules


def screen_check(screens: DataFrame, expected: int | Column, key: Sequence[str] = ("id",), **options) -> DataFrame:
    """Violations of the screen rules."""
    return check(screens, screen_rules(expected, **options), key)


def evidence_index(screens: DataFrame, journeys: DataFrame) -> dict[str, DataFrame]:
    """Integrity of edges and journeys, and screens with the category of their first journey, in index order.

    ``journeys(position, title, nodes)``: positions are the list order.
    """
    edges = screens.select("id", F.explode("transitions").alias("e")).select("id", F.col("e.to").alias("to"))
    members = journeys.select("position", "title", F.explode("nodes").alias("node"))
    nodes = screens.select("id")
    member_ids = members.withColumnRenamed("node", "id")
    return {
        "unknown_targets": dangling_edges(edges, nodes, "to", "id"),
        "unknown_members": dangling_edges(members.select(F.col("node").alias("to")), nodes, "to", "id"),
        "uncovered": uncovered(nodes, members, "id", "node"),
        "screens": first_membership(screens, member_ids, "id", "title", "position", "category").orderBy("index"),
    }


def evidence_problems(screens: DataFrame, journeys: DataFrame, files: DataFrame, file: str, expected: int | Column,
                      **options) -> DataFrame:
    """What keeps an index from being made: ``problem``, ``item`` and ``n_rows``; an index without a row here is sound.

    ``count``: not as many screens as ``expected`` (``n_rows`` has how many). ``duplicate_id``: an id of several screens.
    ``no_file``: no file is named after the screen's index. ``unknown_target`` and ``unknown_member``: an edge or a journey
    leads to no screen. ``uncovered``: a screen that no journey has. ``rule_...``: a broken rule of ``screen_rules``, which
    takes the ``options``.
    """
    found = evidence_index(screens, journeys)
    limit = F.lit(expected) if isinstance(expected, int) else expected

    def as_problems(df: DataFrame, problem: str | Column, item: ColumnLike, n: str | None = None) -> DataFrame:
        name = F.lit(problem) if isinstance(problem, str) else problem
        rows = df.select(name.alias("problem"), as_column(item).cast("string").alias("item"),
                         (F.col(n) if n else F.lit(1)).cast("bigint").alias("n_rows"))
        return rows if n else rows.groupBy("problem", "item").agg(F.sum("n_rows").alias("n_rows"))

    parts = [
        as_problems(screens.agg(F.count(F.lit(1)).alias("n")).where(F.col("n") != limit), "count", F.lit(None), "n"),
        as_problems(duplicates(screens, [], ["id"]), "duplicate_id", "id", "n_rows"),
        as_problems(match_by_suffix(screens.select("id", "index"), files, "index", file).where(~F.col("found")), "no_file", "id"),
        as_problems(found["unknown_targets"], "unknown_target", "to", "n_edges"),
        as_problems(found["unknown_members"], "unknown_member", "to", "n_edges"),
        as_problems(found["uncovered"], "uncovered", "id"),
        as_problems(screen_check(screens, expected, **options), F.concat(F.lit("rule_"), "rule"), "id"),
    ]
    return reduce(DataFrame.unionByName, parts)
