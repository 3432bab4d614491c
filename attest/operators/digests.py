"""Declared against observed content, upload planning, checksum listings."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from attest.functions.columns import ColumnLike, as_column, first_of
from attest.functions.content import byte_length, digest
from attest.operators.skew import SLICE_ROWS, OrderedScan, lookup_join
from attest.session import ship_with_plans

ship_with_plans(__name__)


def verify_digests(
    expected: DataFrame, actual: DataFrame, on: Sequence[str], slice_rows: int | None = SLICE_ROWS
) -> DataFrame:
    """Compare declared ``size`` and ``sha256`` with what is there (one actual row per key).

    Adds ``verdict``: ``match``, ``size_mismatch``, ``digest_mismatch`` or ``missing``.
    """
    seen = actual.select(*on, F.col("size").alias("actual_size"), F.col("sha256").alias("actual_sha256"),
                         F.lit(True).alias("__seen"))
    joined = lookup_join(expected, seen, on, slice_rows=slice_rows)
    return joined.withColumn(
        "verdict",
        first_of(
            (F.col("__seen").isNull(), "missing"),
            (~F.col("size").eqNullSafe(F.col("actual_size")), "size_mismatch"),
            (~F.col("sha256").eqNullSafe(F.col("actual_sha256")), "digest_mismatch"),
            otherwise=F.lit("match"),
        ),
    ).drop("__seen")


def plan_uploads(
    local: DataFrame, remote: DataFrame, on: Sequence[str], slice_rows: int | None = SLICE_ROWS
) -> DataFrame:
    """What publishing each local file would do.

    ``remote`` has ``declared_sha256`` (may be null or stale) and ``computed_sha256``. An absent file is
    uploaded; one whose declared or computed digest is equal is skipped; otherwise it is a conflict.
    """
    there = remote.select(*on, "declared_sha256", "computed_sha256", F.lit(True).alias("__there"))
    joined = lookup_join(local, there, on, slice_rows=slice_rows)
    action = first_of(
        (F.col("__there").isNull(), "upload"),
        (F.col("declared_sha256") == F.col("sha256"), "skip"),
        (F.col("computed_sha256") == F.col("sha256"), "skip"),
        otherwise=F.lit("conflict"),
    )
    return joined.withColumn("action", action).drop("__there")


def undecided(local: DataFrame, remote_declared: DataFrame, on: Sequence[str]) -> DataFrame:
    """Remote files whose declared digest does not prove them equal: only these need their content read."""
    wanted = local.select(*on, F.col("sha256").alias("__want"))
    return (
        remote_declared.join(wanted, list(on))
        .where(~F.coalesce(F.col("declared_sha256") == F.col("__want"), F.lit(False)))
        .drop("__want")
    )


def checksum_listing(
    df: DataFrame,
    by: Sequence[str],
    order: Sequence[str],
    name: ColumnLike,
    sha256: ColumnLike,
    block_lines: int = 10_000,
    slice_rows: int = SLICE_ROWS,
) -> DataFrame:
    """Ordered ``digest  name`` lines per group, each ending in a newline, and the digest of that text.

    A listing longer than ``block_lines`` continues in numbered blocks, so no row holds an unbounded text;
    concatenating a group's blocks in order gives the whole listing.
    """
    line = F.concat(as_column(sha256), F.lit("  "), as_column(name).cast("string"), F.lit("\n"))
    block = F.floor((F.col("__pos") - 1) / F.lit(block_lines)).cast("bigint")
    listing = _blocks(df, by, order, line, block, "", slice_rows)
    return listing.withColumn("listing_sha256", digest("text"))


def listing_digest(df: DataFrame, by: Sequence[str], order: Sequence[str], name: ColumnLike, sha256: ColumnLike) -> DataFrame:
    """The digest of each group's whole listing, as ``checksum_listing`` writes it, and its number of lines.

    A digest of a text is one pass over it. Lines are sorted by Spark, which spills, and stream through one running
    hash: a group of any size needs memory for one batch of lines.
    """
    line = F.concat(as_column(sha256), F.lit("  "), as_column(name).cast("string"), F.lit("\n"))
    rows = df.select(*by, *[c for c in order if c not in by], line.cast("binary").alias("__line"))
    rows = rows.repartition(*by).sortWithinPartitions(*by, *order).select(*by, "__line")
    keys = [rows.schema[c] for c in by]
    out = T.StructType([*keys, T.StructField("n_lines", T.LongType()), T.StructField("listing_sha256", T.StringType())])

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, running, n = None, None, 0

        def done() -> pa.RecordBatch:
            values = [*group, n, running.hexdigest()]
            return pa.RecordBatch.from_arrays(
                [pa.array([v], t) for v, t in zip(values, [*types, pa.int64(), pa.string()])], [*by, "n_lines", "listing_sha256"])

        for batch in batches:
            types = [batch.column(i).type for i in range(len(by))]
            columns = [batch.column(i).to_pylist() for i in range(len(by))]
            for *key, text in zip(*columns, batch.column(len(by)).to_pylist()):
                if key != group:
                    if group is not None:
                        yield done()
                    group, running, n = key, hashlib.sha256(), 0
                if text is not None:
                    running.update(text)
                n += 1
        if group is not None:
            yield done()

    return rows.mapInArrow(hashed, out)


def concat_corpus(
    df: DataFrame,
    by: Sequence[str],
    order: Sequence[str],
    title: ColumnLike,
    url: ColumnLike,
    body: ColumnLike,
    block_bytes: int = 16 << 20,
    slice_rows: int = 100_000,
) -> DataFrame:
    """Pages as one text per group: a heading with title and address, a blank line, the body.

    Pages are joined by a blank line. A group larger than ``block_bytes`` continues in numbered blocks, each
    holding the whole pages that start within its share of the bytes. Pages are wide rows, so slices are
    shorter than elsewhere.
    """
    page = F.concat(F.lit("# "), as_column(title).cast("string"), F.lit(" ("), as_column(url).cast("string"),
                    F.lit(")\n\n"), F.coalesce(as_column(body), F.lit("")))
    start = F.col("__end") - byte_length("__line")
    block = F.floor(start / F.lit(block_bytes)).cast("bigint")
    return _blocks(df, by, order, page, block, "\n\n", slice_rows)


def _blocks(df: DataFrame, by: Sequence[str], order: Sequence[str], line: Column, block: Column, separator: str,
            slice_rows: int) -> DataFrame:
    """Join a group's texts in order, block by block; ``block`` is told the position and the bytes so far."""
    lines = df.select(*by, *[c for c in order if c not in by], line.alias("__line"))
    totals = {"__pos": F.lit(1), "__end": byte_length("__line")}
    numbered = OrderedScan(lines, by, order, slice_rows).running(total=totals).result()
    entries = F.array_sort(F.collect_list(F.struct("__pos", "__line")))
    return (
        numbered.groupBy(*by, block.alias("block"))
        .agg(F.count(F.lit(1)).alias("n_lines"), entries.alias("__e"))
        .select(*by, "block", "n_lines",
                F.array_join(F.transform("__e", lambda e: e["__line"]), separator).alias("text"))
    )
