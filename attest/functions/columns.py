"""Small helpers shared by the column builders."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ColumnLike = Column | str

# White space in the Unicode sense, and the edges of an ASCII word. Spelled out, because what
# ``\s`` and ``\b`` cover differs between regular expression engines and Java versions.
SPACE = r"\s\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\ufeff"
WORD_START = r"(?<![A-Za-z0-9_])"
WORD_END = r"(?![A-Za-z0-9_])"


def as_column(value: ColumnLike) -> Column:
    return F.col(value) if isinstance(value, str) else value


def matches(value: ColumnLike, pattern: str) -> Column:
    """Whole-value match that also rejects a trailing newline; null never matches."""
    return F.coalesce(as_column(value).rlike(rf"\A(?:{pattern})\z"), F.lit(False))


def first_of(*cases: tuple[Column, str], otherwise: Column | None = None) -> Column:
    """Label of the first case that holds; null conditions count as not holding."""
    chain = None
    for condition, label in cases:
        condition = F.coalesce(condition, F.lit(False))
        chain = F.when(condition, label) if chain is None else chain.when(condition, label)
    return chain if otherwise is None else chain.otherwise(otherwise)
