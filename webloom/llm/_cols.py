"""Column handling shared by the operators.

Inputs may carry extra columns whatever their names, so every operator works on columns picked by exact name
under names of its own, and a filtering operator restores the input's columns at the end.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def positional(df: DataFrame, prefix: str = "wl_in_") -> tuple[DataFrame, dict[str, str]]:
    """df under positional names, and the positional name of each column (the first of equal names)."""
    where: dict[str, str] = {}
    for i, name in enumerate(df.columns):
        where.setdefault(name, f"{prefix}{i}")
    return df.toDF(*[f"{prefix}{i}" for i in range(len(df.columns))]), where


def pick(df: DataFrame, **kinds: str) -> DataFrame:
    """Only the named columns, cast to their kinds; a missing one is null throughout."""
    pos, where = positional(df)
    return pos.select(*[(F.col(where[n]) if n in where else F.lit(None)).cast(k).alias(n) for n, k in kinds.items()])


def with_picked(df: DataFrame, **kinds: str) -> tuple[DataFrame, list[str]]:
    """df under positional names plus the picked columns as wl_<name>; and the positional names, to go back by."""
    pos, where = positional(df)
    added = {f"wl_{n}": (F.col(where[n]) if n in where else F.lit(None)).cast(k) for n, k in kinds.items()}
    return pos.withColumns(added), pos.columns


def restore(df: DataFrame, positions: list[str], names: list[str]) -> DataFrame:
    return df.select(*positions).toDF(*names)
