"""Referential integrity and coverage of record graphs."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attest.functions.columns import ColumnLike, as_column, first_of
from attest.operators.skew import SLICE_ROWS, lookup_join


def dangling_edges(edges: DataFrame, nodes: DataFrame, target: str, node: str) -> DataFrame:
    """Edge targets that are no node, with the number of edges pointing there.

    Edges are counted per target before the join, so a target that draws most edges is one row in it.
    """
    per_target = edges.groupBy(target).agg(F.count(F.lit(1)).alias("n_edges"))
    return per_target.join(nodes, per_target[target] == nodes[node], "left_anti")


def uncovered(nodes: DataFrame, memberships: DataFrame, node: str, member: str) -> DataFrame:
    """Nodes that belong to no journey."""
    covered = memberships.select(F.col(member).alias("__m")).distinct()
    return nodes.join(covered, nodes[node] == covered["__m"], "left_anti")


def coverage(nodes: DataFrame, memberships: DataFrame, node: str, member: str) -> DataFrame:
    """One row: nodes, distinct members, and whether the two numbers agree."""
    n = nodes.agg(F.count(node).alias("n_nodes"))
    m = memberships.agg(F.countDistinct(member).alias("n_members"))
    both = n.select("n_nodes", F.lit(None).cast("bigint").alias("n_members")).unionByName(
        m.select(F.lit(None).cast("bigint").alias("n_nodes"), "n_members")
    )
    return both.agg(F.max("n_nodes").alias("n_nodes"), F.max("n_members").alias("n_members")).withColumn(
        "covered", F.col("n_nodes") == F.col("n_members")
    )


def match_by_suffix(
    items: DataFrame, files: DataFrame, index: str, file: str, extension: str = "png"
) -> DataFrame:
    """Join an item to the first file named ``... {index}.{extension}``; ``found`` tells a missing one.

    The index is taken out of the file name, so this is an ordinary equality join.
    """
    digits = F.regexp_extract(F.col(file), rf" (0|[1-9][0-9]*)\.{extension}\z", 1)
    keyed = (
        files.select(F.col(file).alias("matched_file"), digits.try_cast("bigint").alias("__i"))
        .where(F.col("__i").isNotNull())
        .groupBy("__i")
        .agg(F.min("matched_file").alias("matched_file"))
    )
    joined = items.join(keyed, items[index] == keyed["__i"], "left").drop("__i")
    return joined.withColumn("found", F.col("matched_file").isNotNull())


def expect_matrix(
    states: DataFrame,
    captures: DataFrame,
    state: str,
    dims: Mapping[str, Sequence[str]],
    metadata: str | None = None,
    taken_at: str | None = None,
    started_at: str | None = None,
) -> DataFrame:
    """One row per state and combination of the declared dimensions, with how many captures it has.

    ``verdict``: ``missing``, ``ambiguous``, ``metadata`` (the capture's ``metadata`` differs from its
    state's), ``stale`` (taken before the state's ``started_at``) or ``ok``. The dimensions are declared
    lists, expanded per state in place; captures are counted before the join.
    """
    expected = states
    for name, values in dims.items():
        expected = expected.withColumn(name, F.explode(F.array(*[F.lit(v) for v in values])))
    keys = [state, *dims]
    facts = [F.count(F.lit(1)).alias("n_captures")]
    if metadata:
        facts.append(F.max(metadata).alias("__metadata"))
    if taken_at:
        facts.append(F.min(taken_at).alias("__taken"))
    actual = captures.groupBy(*keys).agg(*facts)
    joined = expected.join(actual, keys, "left").withColumn("n_captures", F.coalesce("n_captures", F.lit(0)))
    cases: list[tuple[Column, str]] = [(F.col("n_captures") == 0, "missing"), (F.col("n_captures") > 1, "ambiguous")]
    if metadata:
        cases.append((~F.col("__metadata").eqNullSafe(F.col(metadata)), "metadata"))
    if taken_at:
        cases.append((~F.coalesce(F.col("__taken") >= F.col(started_at), F.lit(False)), "stale"))
    return joined.withColumn("verdict", first_of(*cases, otherwise=F.lit("ok"))).drop("__metadata", "__taken")


def fold_captures(
    df: DataFrame, by: Sequence[str], dims: Mapping[str, Sequence[str]], value: ColumnLike
) -> DataFrame:
    """One row per group: a map keyed by the joined dimensions (such as ``phone-dark``), and how many rows it took.

    The dimensions are declared lists; each of their combinations is one conditional aggregate, so a group
    is folded map-side whatever its size. Combinations without a row have no entry.
    """
    labels = ["-".join(parts) for parts in product(*dims.values())]
    label = F.concat_ws("-", *[F.col(d) for d in dims])
    cells = [F.max(F.when(label == k, as_column(value))).alias(f"__{i}") for i, k in enumerate(labels)]
    counted = F.count_if(label.isin(*labels)).alias("n_captures")
    folded = df.groupBy(*by).agg(counted, *cells)
    keyed = F.map_from_arrays(F.array(*[F.lit(k) for k in labels]), F.array(*[F.col(f"__{i}") for i in range(len(labels))]))
    return folded.select(*by, "n_captures", F.map_filter(keyed, lambda _, v: v.isNotNull()).alias("captures"))


def missing_required(required: DataFrame, present: DataFrame, item: str) -> DataFrame:
    """Required items that were never seen."""
    return required.join(present.select(item).distinct(), item, "left_anti")


def extract_items(df: DataFrame, text: ColumnLike, pattern: str, name: str = "item") -> DataFrame:
    """Every match of the pattern's first group, one row each."""
    return df.withColumn(name, F.explode(F.regexp_extract_all(as_column(text), F.lit(pattern), F.lit(1))))


def outside_allowlist(
    items: DataFrame, item: ColumnLike, exact: Sequence[str], prefixes: Sequence[str], forbidden: str | None = None
) -> DataFrame:
    """Items neither listed nor under an allowed prefix (``unexpected``), or matching a forbidden pattern.

    The lists are configuration and live in the plan: one filter, no join.
    """
    i = as_column(item)
    allowed = i.isin(*exact)
    for prefix in prefixes:
        allowed = allowed | i.startswith(prefix)
    reason = first_of(
        (i.rlike(forbidden) if forbidden else F.lit(False), "forbidden"),
        (~F.coalesce(allowed, F.lit(False)), "unexpected"),
    )
    return items.withColumn("reason", reason).where(F.col("reason").isNotNull())


def first_membership(
    nodes: DataFrame,
    memberships: DataFrame,
    node: str,
    title: str,
    position: str,
    category: str,
) -> DataFrame:
    """Give each node the title of the first journey (by ``position``) that holds it.

    The node's own category moves to ``state_category``. Memberships are reduced to one row per node
    with map-side combining before the join, so a node in very many journeys is no hot key.
    """
    first = memberships.groupBy(node).agg(F.min_by(title, position).alias("__title"))
    joined = nodes.withColumnRenamed(category, "state_category").join(first, node, "left")
    return joined.withColumnRenamed("__title", category)


def resolve_edges(
    edges: DataFrame, nodes: DataFrame, target: str, node: str, slice_rows: int | None = SLICE_ROWS
) -> DataFrame:
    """Every edge with ``known``: whether its target exists. Use when the edges themselves are needed."""
    known = nodes.select(F.col(node).alias(target), F.lit(True).alias("known"))
    joined = lookup_join(edges, known, [target], slice_rows=slice_rows)
    return joined.withColumn("known", F.coalesce("known", F.lit(False)))
