"""Joins on keys of which null is one like any other."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def attach(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Joins on equal keys, null being equal to null; the keys of left stay."""
    named = right.withColumnsRenamed({k: "_of_" + k for k in keys})
    same = reduce(lambda a, b: a & b, (F.col(k).eqNullSafe(F.col("_of_" + k)) for k in keys))
    return left.join(named, same, how).drop(*("_of_" + k for k in keys))
