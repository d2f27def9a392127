"""Greedy packing of groups of any size: jumps over prefix sums inside blocks, and blocks composed as functions.

Rows are dealt by ranges of (group, order). A group that begins in a task is packed there. Of the one group that may have begun
before, a task can't know how full the open chunk is when it starts, so it tells what its rows do to any fill: the more the chunk
holds, the earlier the first new one begins. From each row, a jump leads to the start of the next chunk (a binary search in prefix
sums), so all that follows a first start is known from the right end of a block of BLOCK rows. A block's function is thus a short
list (one entry for each row that can be the first start, no more than fit into one chunk) from fill to (chunks begun, fill at the
end), and functions of adjacent blocks compose to one of the same kind. One row for each task, with its function, then gives all
tasks the fill they start with, and only rows of groups that cross tasks are packed once more.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, LongType, StructField, StructType

from emberlog.operators.places import starts
from emberlog.sources.written import saved

#: Rows of a block.
BLOCK = 65_536


def next_starts(sizes: np.ndarray, most: int) -> np.ndarray:
    """For a chunk that starts at each row, the row where the next one starts, or len(sizes).

    A chunk ends before the first row that would take it beyond most, but not before it holds more than nothing.
    """
    n = len(sizes)
    sums = np.concatenate([[0], np.cumsum(sizes)])
    full = np.searchsorted(sums[1:], sums[:-1] + most, side="right")
    # The first row from each on that isn't empty: the chunk goes on to the one after it at least.
    filled = np.where(sizes > 0, np.arange(n), n)
    filled = np.minimum.accumulate(filled[::-1])[::-1] if n else filled
    return np.minimum(np.maximum(full, filled + 1), n)


def _ends(sizes: np.ndarray, jumps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For a chunk that starts at each row: how many chunks begin from there on, that one included, and the last one's fill."""
    n = len(sizes)
    total = int(sizes.sum())
    sums = np.concatenate([[0], np.cumsum(sizes)]).tolist()
    to, begun, fill = jumps.tolist(), [0] * (n + 1), [0] * (n + 1)
    for i in range(n - 1, -1, -1):
        j = to[i]
        begun[i], fill[i] = (1, total - sums[i]) if j >= n else (begun[j] + 1, fill[j])
    return np.array(begun[:n], np.int64), np.array(fill[:n], np.int64)


def block_function(sizes: np.ndarray, most: int) -> tuple[list[int], list[int], list[int], int]:
    """least, begun, fill, total. With a fill of u > 0, entry i holds for the first i whose least is under u: so many chunks begin and
    the last one's fill is fill[i]; if there is none, no chunk begins and total is added. Entry 0 is for u = 0 and has no least."""
    n, total = len(sizes), int(sizes.sum())
    if not n:
        return [0], [0], [0], 0
    jumps = next_starts(sizes, most)
    begun, fill = _ends(sizes, jumps)
    first = int(jumps[0])
    least, many, after = [0], [int(begun[first]) if first < n else 0], [int(fill[first]) if first < n else total]
    sums = np.cumsum(sizes)
    # A row can be the first start for some fill u >= 1 if the rows before it fit; the first row that can't fit is the last of them.
    last = int(np.searchsorted(sums, most, side="left"))
    for i in range(min(last + 1, n)):
        least.append(most - int(sums[i]))
        many.append(int(begun[i]))
        after.append(int(fill[i]))
    return least, many, after, total


def applied(function: tuple[Sequence[int], Sequence[int], Sequence[int], int], fill: int) -> tuple[int, int]:
    """Chunks begun and the fill after a block, from the fill before it."""
    least, many, after, total = function
    if fill == 0:
        return many[0], after[0]
    # least falls: the first entry under fill.
    lo, hi = 1, len(least)
    while lo < hi:
        mid = (lo + hi) // 2
        lo, hi = (lo, mid) if least[mid] < fill else (mid + 1, hi)
    return (many[lo], after[lo]) if lo < len(least) else (0, fill + total)


def composed(first: tuple, second: tuple) -> tuple[list[int], list[int], list[int], int]:
    """The function of two blocks in a row."""
    least, many, after, total = [list(x) if not isinstance(x, int) else x for x in first]
    for i in range(len(least)):
        more, after[i] = applied(second, after[i])
        many[i] += more
    # Fills that pass the first block without a start meet the second one with total added.
    for bound, n, f in zip(second[0][1:], second[1][1:], second[2][1:], strict=True):
        low = bound - total
        if low < least[-1] or len(least) == 1:
            least.append(low)
            many.append(n)
            after.append(f)
        if low < 1:
            break
    return least, many, after, total + second[3]


def forward(sizes: Sequence[int], most: int, fill: int, chunk: int) -> tuple[list[int], int, int]:
    """The chunk of each row, and the last one's fill and number, from the fill and number of the chunk that is open before."""
    out = []
    for s in sizes:
        if fill > 0 and fill + s > most:
            chunk, fill = chunk + 1, s
        else:
            fill += s
        out.append(chunk)
    return out, fill, chunk


_SUMMARY = "__keys string, __whole boolean, __least array<long>, __begun array<long>, __fills array<long>, __total long, __last string, __fill long, __chunk long"


def _locally(width: int, most: int, block: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Ordered rows, group columns first and the size last, with the task, the row's number in it, whether it is of the task's first
    group, and its chunk if that group began here. The task's last row also carries the function of the first group's rows and the
    state in which the last group ends."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, number, last, first_keys, in_first = TaskContext.get().partitionId(), 0, None, None, True
        fill = chunk = 0
        function, waiting, held = None, [], None

        def absorbed(final: bool) -> None:
            """Takes waiting rows of the first group into its function."""
            nonlocal function, waiting
            if waiting and (final or len(waiting) >= block):
                own = block_function(np.array(waiting, np.int64), most)
                function, waiting = own if function is None else composed(function, own), []

        def out(batch: pa.RecordBatch, columns: list, summary: list | None) -> pa.RecordBatch:
            n = batch.num_rows
            tail = [pa.array([None] * (n - bool(summary)) + ([v] if summary else []), t) for v, t in zip(summary or [None] * len(_TYPES), _TYPES, strict=True)]
            return pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(np.full(n, task)), *columns, *tail], [*batch.schema.names[:-1], *_NAMES])

        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            if held:
                yield out(*held, None)
            keys = batch.columns[:width]
            cuts = np.flatnonzero(starts(keys, n)).tolist() + [n]
            sizes = batch.column(batch.num_columns - 1).to_pylist()
            first, chunks = np.zeros(n, bool), []
            for a, z in zip(cuts[:-1], cuts[1:], strict=True):
                own = repr([k[a].as_py() for k in keys])
                if own != last:
                    in_first = last is None
                    first_keys = own if last is None else first_keys
                    last, fill, chunk = own, 0, 0
                if in_first:
                    first[a:z] = True
                    for i in range(a, z, block):
                        waiting += sizes[i : min(i + block, z)]
                        absorbed(False)
                found, fill, chunk = forward(sizes[a:z], most, fill, chunk)
                chunks += found
            held = batch, [pa.array(np.arange(number, number + n)), pa.array(first), pa.array(chunks, pa.int64())]
            number += n
        if held:
            absorbed(True)
            least, begun, fills, total = function
            yield out(*held, [first_keys, in_first, least, begun, fills, total, last, fill, chunk])

    return run


_LISTS = pa.list_(pa.int64())
_TYPES = [pa.string(), pa.bool_(), _LISTS, _LISTS, _LISTS, pa.int64(), pa.string(), pa.int64(), pa.int64()]
_NAMES = ["__task", "__number", "__first", "chunk", *(f.split()[0] for f in _SUMMARY.split(", "))]


def _entries(table: pa.Table) -> pa.Table:
    """The state before each task whose first group began in an earlier one: one row of each task comes in."""
    tasks, fills, chunks = [], [], []
    last, fill, chunk = None, 0, 0
    for r in table.sort_by("__task").to_pylist():
        before = (fill, chunk) if r["__keys"] == last else (0, 0)
        if r["__keys"] == last:
            tasks.append(r["__task"])
            fills.append(fill)
            chunks.append(chunk)
        if r["__whole"]:
            more, fill = applied((r["__least"], r["__begun"], r["__fills"], r["__total"]), before[0])
            chunk = before[1] + more
        else:
            fill, chunk = r["__fill"], r["__chunk"]
        last = r["__last"]
    return pa.table([pa.array(x, pa.int64()) for x in (tasks, fills, chunks)], names=["__t", "__in", "__at"])


def _again(most: int) -> Callable[[pa.Table], pa.Table]:
    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("__number")
        found, _, _ = forward(table.column("__packed_size").to_pylist(), most, table.column("__in")[0].as_py(), table.column("__at")[0].as_py())
        return pa.table([table.column("__task"), table.column("__number"), pa.array(found, pa.int64())], names=["__t", "__n", "__c"])

    return run


def packed(rows: DataFrame, within: Sequence[str], order: Sequence[str], size: str, most: int, block: int = BLOCK) -> DataFrame:
    """Adds chunk (long, from 0): rows fill a chunk in order until the next would exceed most; a larger row stands alone.

    Null and negative sizes count as 0; rows of a null group are a group. order should tell the rows of a group apart. The rows are
    written on the way.
    """
    keys = [f"__k{i}" for i in range(len(within))]
    own = [c for c in rows.columns if c != "chunk"]
    whole = F.greatest(F.coalesce(F.col(size).cast("long"), F.lit(0)), F.lit(0)).cast("long")
    keep = rows.select(*[F.col(c).alias(k) for c, k in zip(within, keys, strict=True)], *own, whole.alias("__packed_size"), whole.alias("__packed_s"))
    by = [*keys, *order]
    fields = [*keep.schema.fields[:-1], StructField("__task", LongType()), StructField("__number", LongType()), StructField("__first", BooleanType()), StructField("chunk", LongType()), *StructType.fromDDL(_SUMMARY).fields]
    local = saved(keep.repartitionByRange(*by).sortWithinPartitions(*by).mapInArrow(_locally(len(keys), most, block), StructType(fields)))
    summary = local.filter("`__keys` IS NOT NULL").select("__task", *_NAMES[4:])
    entry = saved(summary.groupBy().applyInArrow(_entries, "__t long, __in long, __at long"))
    going_on = local.filter("__first").join(F.broadcast(entry), F.col("__task") == F.col("__t")).select("__task", "__number", "__packed_size", "__in", "__at")
    found = going_on.groupBy("__task").applyInArrow(_again(most), "__t long, __n long, __c long")
    rest = local.join(F.broadcast(entry.select("__t")), (F.col("__task") == F.col("__t")) & F.col("__first"), "left_anti").select(*own, "chunk")
    changed = local.filter("__first").join(found, (F.col("__task") == F.col("__t")) & (F.col("__number") == F.col("__n"))).select(*own, F.col("__c").alias("chunk"))
    return rest.unionByName(changed)
