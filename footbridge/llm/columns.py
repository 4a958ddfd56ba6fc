"""Small helpers for tables whose further columns are unknown."""

from __future__ import annotations

from pyspark.sql import DataFrame


def fresh(df: DataFrame, *wanted: str) -> list[str]:
    """Names like ``wanted`` that clash with no column of ``df``, in any case."""
    taken = {c.lower() for c in df.columns}
    names = []
    for name in wanted:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        names.append(name)
    return names


def pruned(df: DataFrame, *names: str) -> DataFrame:
    """Only the columns an operator reads; a clashing further column can't get in its way."""
    return df.select(*[df[n] for n in names])
