"""Sequences for models: sliding windows, packing, labels, splitting, padding."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from emberlog.functions.text import bound
from emberlog.operators.chains import packed
from emberlog.operators.joins import joined
from emberlog.operators.places import placed

LABEL_PAD = -100


def sliding_windows(rows: DataFrame, within: Sequence[str], order: Sequence[str], size: int, stride: int | float | None = None) -> DataFrame:
    """Adds window (from 0) and place: each row once for each window that holds it.

    Window k holds the rows from k * stride on; rows left over at the end (fewer than a stride) make one more window of the last
    size rows. A short group makes one short window. stride: rows, or a share of size (below 1), or None for size.
    """
    step = size if stride is None else max(1, int(size * stride)) if 0 < stride < 1 else int(stride)
    w = Window.partitionBy(*within).orderBy(*order)
    numbered = rows.withColumns({"__i": (F.row_number().over(w) - 1).cast("long"), "__n": F.count(F.lit(1)).over(Window.partitionBy(*within))})
    i, n = F.col("__i"), F.col("__n")
    last = F.floor(F.greatest(n - size, F.lit(0)) / step)
    lowest, highest = F.greatest(F.ceil((i - size + 1) / step), F.lit(0)), F.least(F.floor(i / step), last)
    regular = F.when(lowest <= highest, F.sequence(lowest, highest)).otherwise(F.array().cast("array<bigint>"))
    left = n - last * step - size
    tail = (left > 0) & (left < step) & (i >= n - size)
    ks = F.concat(regular, F.when(tail, F.array(last + 1)).otherwise(F.array().cast("array<bigint>")))
    out = numbered.withColumn("window", F.explode(ks))
    start = F.when(F.col("window") > last, n - size).otherwise(F.col("window") * step)
    return out.withColumn("place", i - start).drop("__i", "__n")


def labelled_chunks(chunked: DataFrame, within: Sequence[str], order: Sequence[str], ids: str, is_label: Column) -> DataFrame:
    """input_ids and labels (those of label rows) of each chunk."""
    inner = F.sort_array(F.collect_list(F.struct(*order, F.col(ids).alias("__ids"), is_label.alias("__on"))))
    out = chunked.groupBy(*within, "chunk").agg(inner.alias("__rows"))
    on = F.filter("__rows", lambda r: F.coalesce(r["__on"], F.lit(False)))
    joined = lambda xs: F.flatten(F.transform(xs, lambda r: r["__ids"]))
    return out.select(*within, "chunk", joined(F.col("__rows")).alias("input_ids"), joined(on).alias("labels"))


def truncated(ids: Column, most: int | float, max_length: int | None = None) -> Column:
    """The first most ids; a share (at most 1, not whole) is of max_length."""
    n = int(max_length * most) if isinstance(most, float) and max_length else int(most)
    return F.slice(ids, 1, n)


def with_separators(sentences: Column, separator: int) -> Column:
    """All sentences in one array, a separator before each but the first."""
    return F.flatten(F.transform(sentences, lambda s, i: F.when(i == 0, s).otherwise(F.concat(F.array(F.lit(separator).cast("int")), s))))


def flatten_sentences(sentences: Column, separator: Column) -> Column:
    """All tokens, a separator after each sentence."""
    return F.flatten(F.transform(sentences, lambda s: F.concat(s, F.array(separator))))


def split_at(ids: Column, token: int, at_end: bool = False) -> Column:
    """Pieces of ids, cut before each token (or after it)."""

    def of(x: Column) -> Column:
        n = F.size(x)
        cuts = F.filter(F.sequence(F.lit(1), n), lambda i: F.element_at(x, i) == token)
        starts = F.concat(F.array(F.lit(1)), F.transform(cuts, lambda i: i + 1 if at_end else i))
        starts = F.filter(F.array_distinct(starts), lambda i: i <= n)

        def pieces(s: Column) -> Column:
            ends = F.concat(F.slice(s, F.lit(2), F.greatest(F.size(s) - 1, F.lit(0))), F.array(n + 1))
            return F.zip_with(s, ends, lambda a, b: F.slice(x, a, b - a))

        return F.when(n > 0, bound(starts, pieces)).otherwise(F.array().cast("array<array<int>>"))

    return bound(ids, of)


def between(ids: Column, begin: int, end: int) -> Column:
    """Runs from each begin to the next end, both included; a run without an end goes to the last id."""
    pieces = F.filter(split_at(ids, begin), lambda p: F.element_at(p, 1) == begin)
    stop = lambda p: F.array_position(p, F.lit(end).cast("int")).cast("int")
    return F.transform(pieces, lambda p: F.when(stop(p) > 0, F.slice(p, F.lit(1), stop(p))).otherwise(p))


def sequences_of(ids: Column, begin: int | None = None, end: int | None = None) -> Column:
    """The sequences that ids hold: runs between both tokens, pieces that one of them opens or closes, or all ids if there is neither.

    Decode each of them to get texts back; what stands outside of runs belongs to none.
    """
    if begin is not None and end is not None:
        return between(ids, begin, end)
    if begin is not None:
        return split_at(ids, begin)
    return split_at(ids, end, at_end=True) if end is not None else F.array(ids)


def tokenized(
    rows: DataFrame, within: Sequence[str], order: Sequence[str], text: str, encode: Callable[[str], Sequence[int]], separator: str | None = None, most: float | None = None, model_length: int = 1024, bos: Sequence[int] = (), eos: Sequence[int] = (), into: str = "input_ids"
) -> DataFrame:
    """Adds the ids of each sentence. With a separator, it stands before each sentence of a group but the first and no special
    tokens are added; without one, each sentence gets bos and eos.

    most: ids of a sentence, special ones included; up to 1 a share of model_length; None doesn't cut. encode is called once for
    each different text of a batch. Null text counts as empty.
    """
    room = None if most is None else int(most * model_length) if most <= 1 else int(most)
    said = F.coalesce(F.col(text), F.lit(""))
    if separator:
        placed_ = placed(rows, within, order, into="__place")
        slim = placed_.withColumn("__said", F.when(F.col("__place") > 0, F.concat(F.lit(separator), said)).otherwise(said)).drop("__place")
    else:
        slim = rows.withColumn("__said", said)
    around = ([], []) if separator else (list(bos), list(eos))
    keep = slim.drop(into, "__said").columns
    schema = StructType([*slim.select(*keep).schema.fields, *StructType.fromDDL(f"`{into}` array<int>").fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            known: dict[str, list[int]] = {}
            found = []
            for t in batch.column(len(keep)).to_pylist():
                if t not in known:
                    inner = list(encode(t))
                    left = None if room is None else max(room - len(around[0]) - len(around[1]), 0)
                    known[t] = ([*around[0], *inner[:left], *around[1]])[:room]
                found.append(known[t])
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(found, pa.list_(pa.int32()))], [*keep, into])

    return slim.select(*keep, "__said").mapInArrow(run, schema)


def padded(ids: Column, length: Column | int, pad: int) -> Column:
    """ids with pad up to length."""
    length = F.lit(length) if isinstance(length, int) else length
    return F.concat(ids, F.array_repeat(F.lit(pad).cast("int"), F.greatest(length - F.size(ids), F.lit(0)).cast("int")))


def decorated(ids: Column, bos: int, eos: int) -> Column:
    return F.concat(F.array(F.lit(bos).cast("int")), ids, F.array(F.lit(eos).cast("int")))


def without_ignored(labels: Column) -> Column:
    return F.filter(labels, lambda x: x != LABEL_PAD)


def kept_references(chunks: DataFrame, policy: str, is_train: Column, labels: str = "labels") -> DataFrame:
    """Chunks by policy: 'none' drops those without labels, 'train_only' keeps them for training only, 'all' keeps them."""
    has = F.size(labels) > 0
    return chunks if policy == "all" else chunks.filter(has | is_train) if policy == "train_only" else chunks.filter(has)


def first_chunk_with_summary(chunks: DataFrame, summaries: DataFrame, on: str, summary: str = "summary") -> DataFrame:
    """Only the first chunk of each instance, with its manual summary as the label."""
    return joined(chunks.filter("chunk = 0").drop("labels"), summaries.select(on, F.col(summary).alias("labels")), on)


def split_by_category(instances: DataFrame, train: str | None, evaluate: str | None, column: str = "category") -> DataFrame:
    """Adds in_train and in_eval: whether the categories hold the name; without a name, all do."""
    has = lambda name: F.lit(True) if name is None else F.array_contains(column, name)
    return instances.withColumns({"in_train": has(train), "in_eval": has(evaluate)})


__all__ = [
    "LABEL_PAD", "between", "decorated", "first_chunk_with_summary", "flatten_sentences", "kept_references", "labelled_chunks", "packed", "padded", "sequences_of", "sliding_windows", "split_at", "split_by_category", "tokenized", "truncated", "with_separators", "without_ignored",
]
