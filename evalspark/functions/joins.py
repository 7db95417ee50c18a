"""Joins on group keys in which null is a key like any other."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def on_groups(left: DataFrame, right: DataFrame, by: list[str], how: str = "inner") -> DataFrame:
    """`left` with the other columns of `right`; keys that are null on both sides meet."""
    renamed = right.withColumnsRenamed({k: f"_right_{k}" for k in by})
    same = F.lit(True)
    for k in by:
        same = same & F.col(k).eqNullSafe(F.col(f"_right_{k}"))
    return left.join(renamed, same, how).drop(*(f"_right_{k}" for k in by))
