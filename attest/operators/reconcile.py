"""Desired against existing state."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attest.functions.columns import ColumnLike, as_column, first_of
from attest.functions.predicates import is_version
from attest.operators.skew import SLICE_ROWS, OrderedScan, lookup_join


def reconcile_links(
    desired: DataFrame,
    existing: DataFrame,
    group: str,
    name: str,
    position: str,
    slice_rows: int = SLICE_ROWS,
    sized_by: DataFrame | None = None,
    existing_groups: DataFrame | None = None,
) -> DataFrame:
    """Action per desired link: ``create``, ``conflict``, ``add``, ``update_path``, ``error`` or ``keep``.

    Both sides have ``group``, ``name``, ``url``, ``path``; ``existing`` also ``id`` and ``position``, and
    the first link of a name wins. A group with nothing existing is created whole. One link with another
    address makes its whole group a conflict. Existing-only links are left alone. A path change needs the
    existing link's id; without it the link is an ``error``. ``existing_groups`` names groups that exist,
    with or without links; groups with links exist anyway. ``sized_by`` is a cheaper table than
    ``desired`` to count groups on.
    """
    sized_by = desired if sized_by is None else sized_by
    first = existing.groupBy(group, name).agg(
        F.min_by(F.struct("url", "path", "id"), F.col(position)).alias("__old")
    )
    known = existing.select(group)
    if existing_groups is not None:
        known = known.unionByName(existing_groups.select(group))
    known_groups = known.distinct().withColumn("__known", F.lit(True))
    # Names are distinct within a desired group, so only the group-level joins can meet a hot key.
    # What the old link says of the new one is told before the next shuffle, so that its address and path stay behind.
    compared = desired.join(first, [group, name], "left").select(
        *desired.columns,
        F.col("__old").isNotNull().alias("__there"),
        (F.col("__old").isNotNull() & ~F.col("__old.url").eqNullSafe(F.col("url"))).alias("__clash"),
        F.col("__old.path").eqNullSafe(F.col("path")).alias("__same_path"),
        F.col("__old.id").alias("__id"),
    )
    groups = (
        compared.groupBy(group)
        .agg(F.bool_or("__clash").alias("__conflict"))
        .join(known_groups, group, "left")
    )
    joined = lookup_join(compared, groups, [group], slice_rows=slice_rows, distinct_by=[name], sized_by=sized_by)
    action = first_of(
        (F.col("__known").isNull(), "create"),
        (F.col("__conflict"), "conflict"),
        (~F.col("__there"), "add"),
        (F.col("__same_path"), "keep"),
        (F.col("__id").isNull(), "error"),
        otherwise=F.lit("update_path"),
    )
    return joined.select(*desired.columns, F.col("__id").alias("existing_id"), action.alias("action"))


def verify_targets(
    releases: DataFrame, commits: DataFrame, tags: DataFrame, slice_rows: int | None = SLICE_ROWS
) -> DataFrame:
    """Check that a release's commit exists and its tag, if any, points at it.

    ``releases(ref, tag)``, ``commits(id)``, ``tags(name, commit_id, target)``. Adds ``verdict``:
    ``missing_commit``, ``new_tag``, ``tag_moved`` or ``tag_matches``.
    """
    known = commits.select(F.col("id").alias("ref"), F.lit(True).alias("__commit"))
    target = F.coalesce(F.nullif(F.col("commit_id"), F.lit("")), F.col("target"))
    pointed = tags.select(F.col("name").alias("tag"), target.alias("tag_target"), F.lit(True).alias("__tag"))
    joined = lookup_join(releases, known, ["ref"], slice_rows=slice_rows)
    joined = lookup_join(joined, pointed, ["tag"], slice_rows=slice_rows, sized_by=releases)
    return joined.withColumn(
        "verdict",
        first_of(
            (F.col("__commit").isNull(), "missing_commit"),
            (F.col("__tag").isNull(), "new_tag"),
            (~F.col("tag_target").eqNullSafe(F.col("ref")), "tag_moved"),
            otherwise=F.lit("tag_matches"),
        ),
    ).drop("__commit", "__tag")


def extends_version(version: ColumnLike, base: ColumnLike) -> Column:
    """The same version, or the base with a ``-suffix``, in the grammar of build versions."""
    v, b = as_column(version), as_column(base)
    extends = F.coalesce((v == b) | v.startswith(F.concat(b, F.lit("-"))), F.lit(False))
    return extends & is_version(v, "build")


def match_pins(
    builds: DataFrame, pins: DataFrame, on: Sequence[str], slice_rows: int | None = SLICE_ROWS
) -> DataFrame:
    """Compare a build's source and version with the pinned ones.

    ``builds(on, source_sha, version, release_version)``, ``pins(on, pinned_sha, pinned_version)``.
    Adds ``verdict``: ``unpinned``, ``source``, ``version``, ``release_version`` or ``ok``.
    """
    pinned = pins.select(*on, "pinned_sha", "pinned_version", F.lit(True).alias("__pin"))
    joined = lookup_join(builds, pinned, on, slice_rows=slice_rows)
    return joined.withColumn(
        "verdict",
        first_of(
            (F.col("__pin").isNull(), "unpinned"),
            (~F.col("source_sha").eqNullSafe(F.col("pinned_sha")), "source"),
            (~F.col("version").eqNullSafe(F.col("pinned_version")), "version"),
            (~extends_version("release_version", "pinned_version"), "release_version"),
            otherwise=F.lit("ok"),
        ),
    ).drop("__pin")


def lookup_context(runs: DataFrame, name: ColumnLike, contexts: Mapping[str, str]) -> DataFrame:
    """Add ``context`` for a run's name and ``unknown_name``. The mapping is configuration, so no join is planned."""
    entries = F.create_map(*[F.lit(x) for pair in contexts.items() for x in pair])
    return runs.withColumn("context", F.element_at(entries, as_column(name))).withColumn(
        "unknown_name", F.col("context").isNull()
    )


def current_options(options: DataFrame, key: str, value: ColumnLike, position: ColumnLike) -> DataFrame:
    """The value that counts for each key: the last one, as text; a missing value reads as empty."""
    text = F.coalesce(as_column(value).cast("string"), F.lit(""))
    return options.groupBy(key).agg(F.max_by(text, as_column(position)).alias("value"))


def option_drift(current: DataFrame, target: DataFrame, key: str) -> DataFrame:
    """Target options that differ from the current ones: ``key``, ``current_value``, ``target_value``.

    ``current`` has one row per key (see ``current_options``). An empty result on a read-back proves
    that every target holds.
    """
    now = current.select(key, F.col("value").alias("current_value"))
    want = target.select(key, F.col("value").cast("string").alias("target_value"))
    joined = want.join(now, key, "left")
    return joined.where(~F.col("current_value").eqNullSafe(F.col("target_value")))


def changed_only(
    df: DataFrame, by: Sequence[str], order: Sequence[str], columns: Sequence[str], slice_rows: int = SLICE_ROWS
) -> DataFrame:
    """Rows whose state differs from the row before; a repeat of the same state changes nothing.

    States are compared by 128 bits of the SHA-256 of their text, so however wide they are, slices carry 16 bytes.
    """
    state = F.substring(F.unhex(F.sha2(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}), 256)), 1, 16)
    with_state = df.withColumn("__state", state)
    scan = OrderedScan(with_state, by, order, slice_rows).running(last={"__prev": F.col("__state")}, inclusive=False)
    return scan.result().where(~F.col("__state").eqNullSafe(F.col("__prev"))).drop("__prev", "__state")
