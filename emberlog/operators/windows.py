"""Log windows: filters by category and time, grouping, pattern partitions, minimum size, time frames.

Entries are rows with an instance, an order column and a message; windows stay in long form (one row for each entry of each
window), keyed by the instance, the group columns, partition_id and, for frames, the anchor.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from emberlog.functions.text import any_match
from emberlog.operators.joins import joined


def category_filter(instances: DataFrame, *sets: Sequence[str], column: str = "category") -> DataFrame:
    """Instances whose categories hold all of any one set; without sets, all; an empty set matches all."""
    if not sets:
        return instances
    keep = F.lit(False)
    for wanted in sets:
        keep = keep | (F.size(F.array_except(F.array(*[F.lit(w) for w in wanted]).cast("array<string>"), F.col(column))) == 0)
    return instances.filter(keep)


def time_bounds(tolerance_ms: int | None = None, range_ms: tuple[int | None, int | None] | None = None) -> tuple[int | None, int | None]:
    """Milliseconds before and after a base time: a tolerance to both sides, or a range with open ends (None)."""
    if tolerance_ms is not None and range_ms is not None:
        raise ValueError("give a tolerance or a range")
    if range_ms is not None:
        return range_ms
    return (None, None) if tolerance_ms is None else (-tolerance_ms, tolerance_ms)


def _shifted(ts: Column, ms: int) -> Column:
    return ts + F.make_dt_interval(secs=F.lit(ms / 1000).cast("decimal(18,6)"))


def in_window(ts: Column, base: Column, bounds: tuple[int | None, int | None]) -> Column:
    """Inclusive at both ends."""
    keep = F.lit(True)
    if bounds[0] is not None:
        keep = keep & (ts >= _shifted(base, bounds[0]))
    if bounds[1] is not None:
        keep = keep & (ts <= _shifted(base, bounds[1]))
    return keep


def time_filter(entries: DataFrame, instances: DataFrame, base: str, bounds: tuple[int | None, int | None] = (-1000, 1000), instance: str = "instance", ts: str = "ts") -> DataFrame:
    """Entries within bounds of their instance's time in column base."""
    bases = instances.select(instance, F.col(base).alias("__base"))
    return joined(entries, bases, instance).filter(in_window(F.col(ts), F.col("__base"), bounds)).drop("__base")


def partition_by_patterns(entries: DataFrame, keys: Sequence[str], order: Sequence[str], patterns: Sequence[str], must_include: bool = False, message: str = "message") -> DataFrame:
    """Adds partition_id: a new one starts at each row that matches any pattern; rows before the first match have 0.

    must_include drops those. Without patterns, all rows of a key have 0.
    """
    if not patterns:
        return entries.withColumn("partition_id", F.lit(0).cast("long"))
    so_far = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    out = entries.withColumn("partition_id", F.sum(any_match(F.col(message), patterns).cast("long")).over(so_far))
    return out.filter(F.col("partition_id") > 0) if must_include else out


def minimum_size(windows: DataFrame, keys: Sequence[str], least: int) -> DataFrame:
    """Windows of at least so many rows."""
    if least <= 1:
        return windows
    return windows.withColumn("__n", F.count(F.lit(1)).over(Window.partitionBy(*keys))).filter(F.col("__n") >= least).drop("__n")


def frame(windows: DataFrame, keys: Sequence[str], patterns: Sequence[str], bounds: tuple[int | None, int | None], message: str = "message", ts: str = "ts", pos: str = "pos") -> DataFrame:
    """A window for each row that matches a pattern: the rows of its key within bounds of it; adds anchor (its pos).

    With two finite bounds, rows meet anchors by key and time bucket, so no row meets all anchors of its key.
    """
    lo, hi = bounds
    anchors = windows.filter(any_match(F.col(message), patterns)).select(*keys, F.col(pos).alias("anchor"), F.col(ts).alias("__at"))
    if lo is not None and hi is not None:
        width = max(hi - lo, 1) * 1000
        micros = lambda c: F.unix_micros(c.cast("timestamp"))
        bucket = lambda c: F.floor(c / F.lit(width))
        anchors = anchors.withColumn("__bucket", F.explode(F.sequence(bucket(micros(F.col("__at")) + lo * 1000), bucket(micros(F.col("__at")) + hi * 1000))))
        met = joined(windows.withColumn("__bucket", bucket(micros(F.col(ts)))), anchors, [*keys, "__bucket"]).drop("__bucket")
    else:
        met = joined(windows, anchors, keys)
    return met.filter(in_window(F.col(ts), F.col("__at"), bounds)).drop("__at")


@dataclass(frozen=True)
class LogWindows:
    """The whole chain: categories, time filter, groups, pattern partitions, minimum size, frames."""

    categories: tuple[tuple[str, ...], ...] = ()
    time_property: str | None = None
    time_bounds: tuple[int | None, int | None] = (-1000, 1000)
    group_by: tuple[str, ...] = ()
    partition_patterns: tuple[str, ...] = ()
    must_include_pattern: bool = False
    minimum_size: int = 0
    frame_patterns: tuple[str, ...] = ()
    frame_bounds: tuple[int | None, int | None] = (None, None)
    instance: str = "instance"
    ts: str = "ts"
    pos: str = "pos"
    message: str = "message"
    keys: tuple[str, ...] = field(init=False, default=())

    def __post_init__(self) -> None:
        keys = (self.instance, *self.group_by, "partition_id")
        object.__setattr__(self, "keys", (*keys, "anchor") if self.frame_patterns else keys)

    @classmethod
    def from_options(cls, options: dict) -> LogWindows:
        """From a config's options (names with dashes, as on a command line)."""
        o = {k.lstrip("-"): v for k, v in options.items()}
        known = {"category", "time-property", "time-tolerance-ms", "time-range-ms", "group-by-columns", "partition-patterns", "partition-must-include-pattern", "partition-minimum-size", "frame-patterns", "frame-time-tolerance-ms", "frame-time-range-ms"}
        if set(o) - known:
            raise ValueError(f"unknown options: {sorted(set(o) - known)}")
        listed = lambda v: tuple(v) if isinstance(v, (list, tuple)) else () if v is None else (v,)
        sets = o.get("category") or ()
        sets = (sets,) if sets and isinstance(sets[0], str) else sets
        end = lambda v: None if v in (None, "None") else int(v)
        span = lambda t, r: time_bounds(end(o.get(t)), tuple(map(end, o[r])) if o.get(r) else None)
        time = span("time-tolerance-ms", "time-range-ms")
        return cls(
            categories=tuple(map(tuple, sets)),
            time_property=o.get("time-property"),
            time_bounds=(-1000, 1000) if time == (None, None) and "time-range-ms" not in o else time,
            group_by=listed(o.get("group-by-columns")),
            partition_patterns=listed(o.get("partition-patterns")),
            must_include_pattern=bool(o.get("partition-must-include-pattern", False)) or "partition-must-include-pattern" in o,
            minimum_size=int(o.get("partition-minimum-size") or 0),
            frame_patterns=listed(o.get("frame-patterns")),
            frame_bounds=span("frame-time-tolerance-ms", "frame-time-range-ms"),
        )

    def named(self, **columns: str) -> LogWindows:
        return replace(self, **columns)

    def build(self, entries: DataFrame, instances: DataFrame | None = None) -> DataFrame:
        """Entries in long form with partition_id and, for frames, anchor; keys names the columns that tell windows apart."""
        if self.categories:
            chosen = category_filter(instances, *self.categories).select(self.instance).distinct()
            entries = joined(entries, chosen, self.instance, "left_semi")
        if self.time_property:
            entries = time_filter(entries, instances, self.time_property, self.time_bounds, self.instance, self.ts)
        groups = [self.instance, *self.group_by]
        out = partition_by_patterns(entries, groups, [self.pos], self.partition_patterns, self.must_include_pattern, self.message)
        out = minimum_size(out, [*groups, "partition_id"], self.minimum_size)
        if self.frame_patterns:
            out = frame(out, [*groups, "partition_id"], self.frame_patterns, self.frame_bounds, self.message, self.ts, self.pos)
        return out
