"""Content digests."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from attest.functions.columns import ColumnLike, as_column


def digest(content: ColumnLike) -> Column:
    """Lower-case SHA-256 of a text (as UTF-8) or of bytes."""
    return F.sha2(as_column(content), 256)


def packed(sha256: ColumnLike) -> Column:
    """A digest in lower-case hex as 33 bytes, any other text as its bytes and a mark; equal where the texts are, never empty.

    What comes out is typed as text, though it need not be UTF-8: Spark takes binary columns for wider than texts, and a
    join would lose its broadcast.
    """
    text = as_column(sha256)
    data = F.unhex(text)
    return F.when(F.lower(F.hex(data)) == text, F.concat(F.lit(b"\0"), data)).otherwise(
        F.concat(F.lit(b"\1"), text.cast("binary"))).cast("string")


def unpacked(value: ColumnLike) -> Column:
    """The text that ``packed`` packed."""
    data = as_column(value).cast("binary")
    rest = F.substring(data, 2, 1 << 30)
    return F.when(F.substring(data, 1, 1) == F.lit(b"\0"), F.lower(F.hex(rest))).otherwise(rest.cast("string"))


def packed_hex(value: ColumnLike, length: int) -> Column:
    """Whether ``packed`` packed exactly ``length`` (even) lower-case hex digits: ``is_hex`` of the text."""
    column = as_column(value)
    return F.coalesce(column.startswith(F.lit("\0")) & (F.octet_length(column) == 1 + length // 2), F.lit(False))


def byte_length(content: ColumnLike) -> Column:
    return F.octet_length(as_column(content)).cast("bigint")
