"""Event sets over windows: cumulated, common and excluded events, and statistics of windows."""

from __future__ import annotations

from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberlog.operators.joins import joined
from emberlog.operators.places import placed
from emberlog.sources.written import saved

#: Windows of a block of the ordered fold.
BLOCK = 4096


def cumulated_events(windows: DataFrame, event: Sequence[str]) -> DataFrame:
    """All events of any window."""
    return windows.select(*event).distinct()


def common_events(windows: DataFrame, keys: Sequence[str], event: Sequence[str]) -> DataFrame:
    """Events that stand in all windows."""
    pairs = windows.select(*keys, *event).distinct()
    total = windows.select(*keys).distinct().agg(F.count(F.lit(1)).alias("__total"))
    return pairs.groupBy(*event).agg(F.count(F.lit(1)).alias("__n")).join(F.broadcast(total), F.col("__n") == F.col("__total")).select(*event)


def common_events_in_order(windows: DataFrame, keys: Sequence[str], order: Sequence[str], event: Sequence[str], block: int = BLOCK) -> DataFrame:
    """The running intersection over windows in order, which starts anew after it has become empty.

    Windows are placed in order, and a task folds a block of them at a time. It can't know the set that comes in, so it tells for
    each event of its first window how many windows from the first on hold it: what comes in lasts as long as the longest of its
    events. It also tells which set is left if the fold starts anew at each window where that may be, and for the events that
    last through the block that they do. One such summary for each block, no larger than its first and last windows, then gives
    the result in order.
    """
    name = F.struct(*event)
    # A window's place is that of its first row.
    firsts = windows.groupBy(*keys).agg(F.min(F.struct(*order)).alias("__at"))
    numbered = placed(firsts.select(*keys, "__at"), (), ["__at", *keys], into="__window")
    pairs = joined(windows.select(*keys, name.alias("__e")).distinct(), numbered.select(*keys, "__window"), keys)
    # Events travel as JSON, which is the same for equal values.
    slim = pairs.select(F.floor(F.col("__window") / block).alias("block"), F.col("__window").alias("window"), F.to_json("__e", {"ignoreNullFields": "false"}).alias("event"))
    summary = slim.groupBy("block").applyInArrow(_summary, "block long, windows long, first array<string>, lasts array<long>, starts array<long>, left array<array<string>>")
    folded = saved(summary).groupBy().applyInArrow(_folded, "event string")
    kinds = windows.select(*event).schema
    return folded.select(F.from_json("event", kinds).alias("__e")).select("__e.*")


def _fold(sets: list[set], start: int, known: dict[int, frozenset]) -> frozenset:
    """What is left after all sets if the fold starts with the one at start; known keeps what starts have given."""
    chain = []
    while start not in known:
        chain.append(start)
        if start >= len(sets):
            known[start] = frozenset()
            break
        now, at = sets[start], start + 1
        while now and at < len(sets):
            now, at = now & sets[at], at + 1
        if now:
            known[start] = frozenset(now)
            break
        start = at
    found = known[start]
    known.update(dict.fromkeys(chain, found))
    return found


def _summary(table: pa.Table) -> pa.Table:
    table = table.sort_by("window")
    by: dict[int, set] = {}
    for w, e in zip(table.column("window").to_pylist(), table.column("event").to_pylist(), strict=True):
        by.setdefault(w, set()).add(e)
    sets = list(by.values())
    first, lasts, alive = sorted(sets[0]), {}, set(sets[0])
    for k, s in enumerate(sets):
        for e in alive - s:
            lasts[e] = k
        alive &= s
        if not alive:
            break
    lasts |= dict.fromkeys(alive, len(sets))
    # An incoming set whose events last k windows at most is empty after window k + 1, and the fold starts at the one after that.
    starts = sorted({0, 1, *(n + 1 for n in lasts.values() if n < len(sets))})
    known: dict[int, frozenset] = {}
    left = [sorted(_fold(sets, s, known)) for s in starts]
    texts = pa.list_(pa.string())
    columns = [pa.array([table.column("block")[0].as_py()]), pa.array([len(sets)]), pa.array([first], texts), pa.array([[lasts[e] for e in first]], pa.list_(pa.int64())), pa.array([starts], pa.list_(pa.int64())), pa.array([left], pa.list_(texts))]
    return pa.table(columns, names=["block", "windows", "first", "lasts", "starts", "left"])


def _folded(table: pa.Table) -> pa.Table:
    """Blocks' summaries, in order, to the events that are left."""
    now: set = set()
    for batch in table.sort_by("block").to_batches(max_chunksize=64):
        for r in batch.to_pylist():
            lasts, left = dict(zip(r["first"], r["lasts"], strict=True)), dict(zip(r["starts"], r["left"], strict=True))
            if not now:
                now = set(left[0])
                continue
            longest = max((lasts.get(e, 0) for e in now), default=0)
            now = {e for e in now if lasts.get(e, 0) == r["windows"]} if longest == r["windows"] else set(left[longest + 1])
    return pa.table({"event": pa.array(sorted(now), pa.string())})


def entries_of(entries: DataFrame, events: DataFrame, event: Sequence[str]) -> DataFrame:
    """Entries whose event is among events."""
    return joined(entries, events, event, "left_semi")


def summary_events(windows: DataFrame, keys: Sequence[str], event: Sequence[str], excluded: DataFrame | None = None, only_common: bool = True) -> DataFrame:
    """Common (or all) events without the excluded ones."""
    found = common_events(windows, keys, event) if only_common else cumulated_events(windows, event)
    return found if excluded is None else joined(found, excluded, event, "left_anti")


def window_stats(windows: DataFrame, keys: Sequence[str], ts: str = "ts", pos: str = "pos") -> DataFrame:
    """n (rows) and seconds (last less first time, in the order of pos) of each window."""
    micros = F.unix_micros(F.col(ts).cast("timestamp"))
    return windows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), ((F.max_by(micros, F.col(pos)) - F.min_by(micros, F.col(pos))) / 1e6).alias("seconds")
    )
