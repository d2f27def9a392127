"""Orders, limits and picks: stable merges, top k, consecutive duplicates, limits by group."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def merged_order(entries: DataFrame, instance: str, order: Sequence[str | Column], pos: str = "pos") -> DataFrame:
    """Adds pos: the place (from 1) of a row in its instance, all its files merged by order."""
    return entries.withColumn(pos, F.row_number().over(Window.partitionBy(instance).orderBy(*order)).cast("long"))


def top_k(df: DataFrame, k: int, by: Sequence[str | Column], within: Sequence[str] = ()) -> DataFrame:
    """The first k rows by order, of all or of each group."""
    if not within:
        return df.orderBy(*by).limit(k)
    rank = F.row_number().over(Window.partitionBy(*within).orderBy(*by))
    return df.withColumn("__k", rank).filter(F.col("__k") <= k).drop("__k")


def consecutive_distinct(df: DataFrame, within: Sequence[str], order: Sequence[str | Column], value: str) -> DataFrame:
    """Without rows whose value equals that of the row before."""
    w = Window.partitionBy(*within).orderBy(*order)
    flag = (F.row_number().over(w) > 1) & F.lag(value).over(w).eqNullSafe(F.col(value))
    return df.withColumn("__same", flag).filter(~F.col("__same")).drop("__same")


def limit_by_source(df: DataFrame, limits: dict[str, int], default: int | None, source: str, order: Sequence[str | Column]) -> DataFrame:
    """At most so many first rows of each source; 0 or less skips it; None takes all."""
    most = F.lit(default).cast("long")
    for name, n in limits.items():
        most = F.when(F.col(source) == name, F.lit(n).cast("long")).otherwise(most)
    ranked = df.withColumn("__n", F.row_number().over(Window.partitionBy(source).orderBy(*order))).withColumn("__most", most)
    return ranked.filter(F.col("__most").isNull() | (F.col("__n") <= F.col("__most"))).drop("__n", "__most")
