"""Exact quantiles by repeated histogram refinement: counts travel, values don't, so no task holds a group's values.

For each group, each wanted rank lies in a range of values, at first from least to largest. A round counts the range's values in
BINS bins, finds the bin that holds the rank, and goes on with that bin's own least and largest value. A range is done when these
are equal. The least and the largest value have bins of their own, so each round narrows every range; a million evenly spread
values take two or three rounds.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from emberlog.sources.written import dropped, saved

#: Bins of a range in a round; ranges that are broadcast to the values (beyond, they are joined by group).
BINS, BROADCAST_RANGES = 4096, 100_000


def same_group(by: Sequence[str]) -> Column:
    """That the group columns equal those of the same names behind two underscores, nulls included."""
    return reduce(lambda a, b: a & F.col(b).eqNullSafe(F.col(f"__{b}")), by, F.lit(True))


def selected(df: DataFrame, value: str, ranks: Mapping[str, Column], by: Sequence[str] = (), bins: int = BINS) -> DataFrame:
    """The group columns (named __<name>), name (a key of ranks) and x (double): the value at the rank (from 0) that the column gives, which
    may use n, how many values a group has. Nulls and NaN aren't counted; a group without values has no rows."""
    held = [f"__{b}" for b in by]
    v = F.col(value).cast("double")
    rows = df.select(*[F.col(b).alias(h) for b, h in zip(by, held, strict=True)], v.alias("__v")).filter("`__v` IS NOT NULL AND NOT isnan(`__v`)")
    whole = rows.groupBy(*held).agg(F.count("*").alias("n"), F.min("__v").alias("lo"), F.max("__v").alias("hi")).filter("n > 0")
    wanted = F.explode(F.array(*(F.struct(F.lit(k).alias("name"), r.cast("long").alias("rank")) for k, r in ranks.items()))).alias("w")
    # A rank within its range, and how many values the range has.
    now = saved(whole.select(*held, wanted, "lo", "hi").select(*held, "w.name", "w.rank", "lo", "hi"))
    done = now.filter("lo = hi").select(*held, "name", F.col("lo").alias("x"))
    tables = [now]
    while True:
        # Ranges of two ranks are equal or apart, so a value lies in few of them.
        open_ = now.filter("lo < hi")
        ranges = saved(open_.select(*[F.col(h).alias(f"{h}_") for h in held], "lo", "hi").distinct())
        few = ranges.count()
        if not few:
            break
        met = rows.join(F.broadcast(ranges) if few <= BROADCAST_RANGES else ranges, reduce(lambda a, h: a & F.col(h).eqNullSafe(F.col(f"{h}_")), held, F.lit(True)) & F.col("__v").between(F.col("lo"), F.col("hi")))
        share = (F.col("__v") / 2 - F.col("lo") / 2) / (F.col("hi") / 2 - F.col("lo") / 2)
        inner = F.least(F.greatest(F.coalesce(F.floor(F.nanvl(share, F.lit(0.5)) * (bins - 2)), F.lit(0)), F.lit(0)), F.lit(bins - 3)) + 1
        bin_ = F.when(F.col("__v") == F.col("lo"), 0).when(F.col("__v") == F.col("hi"), bins - 1).otherwise(inner).cast("int")
        counted = met.groupBy(*[F.col(f"{h}_") for h in held], "lo", "hi", bin_.alias("bin")).agg(F.count("*").alias("c"), F.min("__v").alias("least"), F.max("__v").alias("most"))
        w = Window.partitionBy(*[f"{h}_" for h in held], "lo", "hi").orderBy("bin")
        counted = counted.withColumn("upto", F.sum("c").over(w)).select(*[F.col(f"{h}_") for h in held], F.col("lo").alias("lo_"), F.col("hi").alias("hi_"), "c", "least", "most", "upto")
        here = reduce(lambda a, h: a & F.col(h).eqNullSafe(F.col(f"{h}_")), held, (F.col("lo") == F.col("lo_")) & (F.col("hi") == F.col("hi_")))
        here &= (F.col("rank") < F.col("upto")) & (F.col("rank") >= F.col("upto") - F.col("c"))
        after = saved(open_.join(counted, here).select(*held, "name", (F.col("rank") - F.col("upto") + F.col("c")).alias("rank"), F.col("least").alias("lo"), F.col("most").alias("hi")))
        dropped(ranges)
        done = done.unionByName(after.filter("lo = hi").select(*held, "name", F.col("lo").alias("x")))
        now = after
        tables.append(now)
    return done


def quantiles(df: DataFrame, value: str, shares: Mapping[str, float], by: Sequence[str] = ()) -> DataFrame:
    """The group columns (named __<name>) and a double for each share (0 to 1): between neighbouring values, linear."""
    place = lambda q: (F.col("n") - 1) * F.lit(float(q))
    ranks = {}
    for name, q in shares.items():
        ranks |= {f"{name}:low": F.floor(place(q)), f"{name}:high": F.ceil(place(q))}
    found = selected(df, value, ranks, by)
    held = [f"__{b}" for b in by]
    wide = found.groupBy(*held).agg(*(F.max(F.when(F.col("name") == k, F.col("x"))).alias(k) for k in ranks))
    count = df.filter(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double"))).groupBy(*[F.col(b).alias(f"{h}_") for b, h in zip(by, held, strict=True)]).agg(F.count("*").alias("n"))
    met = wide.join(count if by else F.broadcast(count), reduce(lambda a, h: a & F.col(h).eqNullSafe(F.col(f"{h}_")), held, F.lit(True)))

    def one(name: str, q: float) -> Column:
        low, high, part = F.col(f"`{name}:low`"), F.col(f"`{name}:high`"), place(q) - F.floor(place(q))
        return F.when(part == 0, low).otherwise(low + (high - low) * part).alias(name)

    return met.select(*held, *(one(name, q) for name, q in shares.items()))


def with_quantiles(groups: DataFrame, df: DataFrame, value: str, shares: Mapping[str, float], by: Sequence[str] = ()) -> DataFrame:
    """groups (one row for each group) with quantiles of df's values; null for groups without any."""
    found = quantiles(df, value, shares, by)
    return groups.join(found if by else F.broadcast(found), same_group(by), "left").drop(*[f"__{b}" for b in by])
