"""Joins by columns of one name on both sides in which null equals null, so no row is lost to a null key."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def joined(left: DataFrame, right: DataFrame, on: Sequence[str] | str, how: str = "inner") -> DataFrame:
    """left's columns, and those of right that aren't keys; how is inner, left, left_semi or left_anti."""
    on = [on] if isinstance(on, str) else list(on)
    named = right.select(*[F.col(c).alias(f"__on_{c}") for c in on], *[c for c in right.columns if c not in on])
    same = reduce(lambda a, c: a & F.col(c).eqNullSafe(F.col(f"__on_{c}")), on, F.lit(True))
    return left.join(named, same, how).drop(*[f"__on_{c}" for c in on])
