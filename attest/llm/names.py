"""Column names that a caller's table does not have."""

from __future__ import annotations

from pyspark.sql import DataFrame


def unused(docs: DataFrame, *names: str) -> list[str]:
    """The names, with underscores after them until no column of ``docs`` has them in any case."""
    taken = {c.lower() for c in docs.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        out.append(name)
    return out
