"""Places and running sums of rows in a total order, also in groups of any size, without a task that holds a group.

Rows are dealt by ranges of (group, order), numbered inside each task, and written; each task's first group may go on from the
tasks before it, and only for that group is there a total to add. There is one such total for each task at most, so the table of
them, which is broadcast, is as small as the number of tasks.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from emberlog.sources.written import saved

PART = "__part"


def starts(columns: Sequence[pa.Array], rows: int) -> np.ndarray:
    """Where a row differs from the one before it in any of the columns; nulls equal nulls, and the first row starts."""
    out = np.zeros(rows, bool)
    out[:1] = True
    for c in columns:
        a, b = c.slice(1), c.slice(0, max(rows - 1, 0))
        differ = pc.or_(pc.fill_null(pc.not_equal(a, b), False), pc.xor(pc.is_null(a), pc.is_null(b)))
        out[1:] |= differ.to_numpy(zero_copy_only=False)
    return out


def _local(within: int, values: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows in order, their first columns those of the group and their last ones values to sum: with the task's number, the place in
    the task's part of the group, and sums up to and with the row in place of the values."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, last, place, sums = TaskContext.get().partitionId(), None, 0, [0] * values
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            keys = batch.columns[:within]
            fresh = starts(keys, n)
            fresh[0] = [k[0].as_py() for k in keys] != last if last is not None else True
            begin = np.maximum.accumulate(np.where(fresh, np.arange(n), -1))
            goes_on = begin < 0
            places = np.where(goes_on, place + np.arange(n), np.arange(n) - begin)
            columns = []
            for i in range(values):
                run_sum = np.cumsum(pc.fill_null(batch.column(batch.num_columns - values + i), 0).to_numpy(zero_copy_only=False).astype(np.int64))
                before = np.where(goes_on, -sums[i], np.where(begin > 0, run_sum[begin - 1], 0))
                columns.append(run_sum - before)
                sums[i] = int(columns[-1][-1])
            last, place = [k[n - 1].as_py() for k in keys], int(places[-1]) + 1
            yield pa.RecordBatch.from_arrays([*batch.columns[: batch.num_columns - values], pa.array(np.full(n, task)), pa.array(places), *map(pa.array, columns)], [*batch.schema.names[: batch.num_columns - values], PART, "__place", *batch.schema.names[batch.num_columns - values :]])

    return run


def placed(rows: DataFrame, within: Sequence[str], order: Sequence[str], into: str = "place", sums: Mapping[str, str] | None = None, descending: Sequence[str] = ()) -> DataFrame:
    """rows with their place (long, from 0) in each group, and for each name in sums the running sum (long) of that column up to and
    with the row; null values add nothing. order should tell the rows of a group apart. descending: columns of order that fall.

    The rows are written on the way.
    """
    sums = dict(sums or {})
    keep = rows.select(*[F.col(c).alias(f"__w{i}") for i, c in enumerate(within)], *rows.columns, *[F.coalesce(F.col(c).cast("long"), F.lit(0).cast("long")).alias(f"__s{i}") for i, c in enumerate(sums.values())])
    keys = [f"__w{i}" for i in range(len(within))]
    by = [*map(F.col, keys), *(F.col(c).desc() if c in descending else F.col(c).asc() for c in order)]
    totals = [f"__s{i}" for i in range(len(sums))]
    fields = keep.schema.fields[: len(keep.columns) - len(sums)]
    schema = StructType([*fields, *(StructField(c, LongType()) for c in (PART, "__place", *totals))])
    local = saved(keep.repartitionByRange(*by).sortWithinPartitions(*by).mapInArrow(_local(len(within), len(sums)), schema))
    ends = local.groupBy(*keys, PART).agg(F.count("*").alias("__n"), *(F.max_by(c, "__place").alias(c) for c in totals))
    before = Window.partitionBy(*keys).orderBy(PART).rowsBetween(Window.unboundedPreceding, -1)
    added = {"__n": F.sum("__n").over(before), **{c: F.sum(c).over(before) for c in totals}}
    ends = saved(ends.select(*[F.col(k).alias(f"{k}_") for k in keys], F.col(PART).alias("__p"), *(e.alias(f"{c}_") for c, e in added.items())).filter("`__n_` IS NOT NULL"))
    same = F.col(PART) == F.col("__p")
    for k in keys:
        same &= F.col(k).eqNullSafe(F.col(f"{k}_"))
    met = local.join(F.broadcast(ends), same, "left")
    plus = lambda c: F.col(c) + F.coalesce(F.col(f"{c}_"), F.lit(0))
    own = [c for c in rows.columns if c not in (into, *sums)]
    return met.select(*own, (F.col("__place") + F.coalesce("__n_", F.lit(0))).alias(into), *(plus(c).alias(name) for c, name in zip(totals, sums, strict=True)))
