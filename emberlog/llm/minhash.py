"""Near duplicates by an LSH forest over MinHash signatures.

Each document's set of word shingles gives HASHES minima. The forest has TREES orders of them: order t starts at its own DEPTH
minima, its region key, and goes on with those after. Documents of equal sets form one class, and class representatives are
sorted by (region, further minima) in each order; neighbours there have the longest common prefix, so crowded regions are
resolved at their own, greater depth first. Links that hold on full sets join classes into components. Then each region that
still holds more than one component is taken up at its least depth: all its pairs across components whose estimated
similarity isn't clearly below the threshold are compared by samples of their sets (whole sets up to SAMPLE shingles), and
those that link or may link are confirmed on full sets, too. No partner or candidate is capped. A pair at the threshold
shares no region with a probability of (1 - threshold**DEPTH)**TREES: 5.6e-11 at 0.85, 4.8e-8 at 0.80. One that does is
passed over, as its estimate from HASHES minima is too low, with a probability of at most LOST (see least_estimate()).

A hot region - much text in common, or a large group of near copies - has one component that holds most of its rows after the
first pass. Its rows are cut into blocks and stay there; only rows of other components go to all blocks of the region.

Signatures, links and labels stay in tables; only counts reach the driver. Documents without words link with nothing. Null
text counts as empty. Rows that share a key are documents of their own that bear the same name; rows without a key get no
component and are kept. An empty table gives an empty table. Columns other than the key and the text don't pass through.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from emberlog.llm.components import components
from emberlog.llm.memory import small_batches, tidy
from emberlog.llm.scratch import dropped, saved
from emberlog.llm.shingles import mixed, shingle_sets, slices

HASHES, TREES, DEPTH = 128, 32, 4
#: Orders whose neighbours are tried first.
FIRST_TREES = 8
#: A pair at the threshold falls below the estimate that counts with this probability at most.
LOST = 1e-9
#: Of its neighbours, a representative tries so many of the best first; the second pass takes up all others.
FIRST_TRIES = 2
#: Shingles of a set that are compared in the second pass: all, or of a larger set this many to half as many.
SAMPLE = 1024
#: Rows of a region that one task takes up; larger regions are cut into blocks.
REGION_ROWS = 1000
#: Regions of more rows find their blocks by a broadcast.
HOT_ROWS = 5000
#: Ids are broadcast to pick texts if they are at most so many; beyond that the texts are shuffled to them.
BROADCAST_IDS = 4_000_000
_A = (mixed(np.arange(1, HASHES + 1, dtype=np.uint64), 0x1234567) | np.uint64(1)).astype(np.uint32)
_B = mixed(np.arange(1, HASHES + 1, dtype=np.uint64), 0x89ABCDE).astype(np.uint32)
_ORDERS = mixed(np.arange(1, TREES + 1, dtype=np.uint64), 0x51ED270B)


def least_estimate(percent: int) -> float:
    """The highest share of equal minima that a pair at the threshold misses with a probability of LOST at most: by the
    binomial tail, as each of HASHES minima is equal with the probability of the similarity."""
    p, tail, equal = percent / 100, 0.0, 0
    while equal < HASHES:
        tail += math.comb(HASHES, equal) * p**equal * (1 - p) ** (HASHES - equal)
        if tail > LOST:
            break
        equal += 1
    return equal / HASHES


def signatures_of(hashes: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """HASHES 16-bit minima for each set; all ones for an empty set."""
    sizes = np.diff(bounds)
    full = np.flatnonzero(sizes)
    out = np.full((len(sizes), HASHES), 0xFFFF, np.uint16)
    small = (mixed(hashes) >> np.uint64(32)).astype(np.uint32)
    at = 0
    while at < len(full):  # chunks that stay in cache
        end = max(at + 1, int(np.searchsorted(bounds[full], bounds[full[at]] + 60_000)))
        part = full[at:end]
        first, last = bounds[part[0]], bounds[part[-1] + 1]
        values, starts = small[first:last], bounds[part] - first
        for j in range(HASHES):
            out[part, j] = np.minimum.reduceat(values * _A[j] + _B[j], starts) >> np.uint32(16)
        at = end
    return out


def _keys(signatures: np.ndarray) -> np.ndarray:
    """A region key for each order. Keys of one order are equal where its DEPTH minima are; those of two orders by chance only."""
    x = np.zeros((len(signatures), TREES), np.uint64)
    for d in range(DEPTH):
        x = (x << np.uint64(16)) | signatures[:, d : DEPTH * TREES : DEPTH].astype(np.uint64)
    return mixed(x) ^ _ORDERS


def _further(signatures: np.ndarray) -> np.ndarray:
    """The next four minima of each of the first orders, as one number."""
    x = np.zeros((len(signatures), FIRST_TREES), np.uint64)
    for d in range(DEPTH, 2 * DEPTH):
        x = (x << np.uint64(16)) | signatures[:, d : d + DEPTH * FIRST_TREES : DEPTH].astype(np.uint64)
    return x


def _node(hashes: np.ndarray, bounds: np.ndarray) -> list[np.ndarray]:
    """Two 64-bit numbers that tell equal sets: the first names the class, the second checks it. Empty sets: 0."""
    sums = [np.zeros(len(bounds) - 1, np.uint64) for _ in range(2)]
    full = np.flatnonzero(np.diff(bounds))
    if len(full):
        for n, s in enumerate(sums):
            s[full] = mixed(np.add.reduceat(mixed(hashes, 0xABCDEF * (n + 1)), bounds[full]))
    return sums


def _signed(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, texts in slices(batch.column(1)):
                hashes, bounds = shingle_sets(texts, k)
                sizes = np.diff(bounds)
                signatures = np.ascontiguousarray(signatures_of(hashes, bounds))
                blob = pa.FixedSizeBinaryArray.from_buffers(pa.binary(2 * HASHES), len(sizes), [None, pa.py_buffer(signatures)])
                columns = [batch.column(0).slice(at, len(sizes)).cast(pa.int64()), pa.array(sizes, pa.int64()), *(pa.array(s.view(np.int64)) for s in _node(hashes, bounds)), blob.cast(pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, ["key", "n", "id", "check", "signature"])

    return run


def _matrix(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint16).reshape(-1, HASHES)


def _placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """id, signature to one row for each order: region, further (null after the first orders), id."""
    for batch in batches:
        for at in range(0, batch.num_rows, 4096):
            part = batch.slice(at, 4096)
            signatures = _matrix(part.column(1))
            keys, further = _keys(signatures), _further(signatures)
            mask = np.ones(keys.shape, bool)
            mask[:, :FIRST_TREES] = False
            deep = np.zeros(keys.shape, np.uint64)
            deep[:, :FIRST_TREES] = further
            ids = np.repeat(part.column(0).to_numpy(), TREES)
            yield pa.RecordBatch.from_arrays([pa.array(keys.ravel().view(np.int64)), pa.array(deep.ravel().view(np.int64), mask=mask.ravel()), pa.array(ids)], ["region", "further", "id"])


def _crowded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by region: those of regions with two or more, in the first orders with the id before them."""
    waiting = None  # the last row, until it is known whether a row of its region follows
    for batch in batches:
        if not batch.num_rows:
            continue
        region, id_ = batch.column(0).to_numpy(), batch.column(2).to_numpy()
        deep = batch.column(1).is_valid().to_numpy(zero_copy_only=False)
        same = np.concatenate([[waiting is not None and waiting[0] == region[0]], region[1:] == region[:-1]])
        has = same & deep
        before = np.where(has, np.concatenate([[waiting[1] if waiting else 0], id_[:-1]]), 0)
        if waiting and (waiting[3] or same[0]):
            yield _rows(*(np.array([x]) for x in (waiting[0], waiting[1], waiting[2], waiting[4])))
        keep = same.copy()
        keep[:-1] |= same[1:]
        keep[-1] = False
        yield _rows(region[keep], id_[keep], before[keep], has[keep])
        waiting = (region[-1], id_[-1], before[-1], bool(same[-1]), bool(has[-1]))
    if waiting and waiting[3]:
        yield _rows(*(np.array([x]) for x in (waiting[0], waiting[1], waiting[2], waiting[4])))


def _rows(region: np.ndarray, id_: np.ndarray, before: np.ndarray, has: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(region, pa.int64()), pa.array(id_, pa.int64()), pa.array(before, pa.int64(), mask=~has)], ["region", "id", "before"])


def _estimated(least: float):
    """a, b, signature of a, signature of b to a, b, estimate, for pairs whose estimate is high enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                estimate = (_matrix(batch.column(2)) == _matrix(batch.column(3))).mean(axis=1)
                keep = pa.array(estimate >= least)
                yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep), batch.column(1).filter(keep), pa.array(estimate).filter(keep)], ["a", "b", "estimate"])

    return run


def _sampled(k: int):
    """text to id and sample: the shingles' 32-bit hashes in ascending order; of large sets those under a power of two."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, texts in slices(batch.column(0)):
                hashes, bounds = shingle_sets(texts, k)
                small = (mixed(hashes, 0x5A17) >> np.uint64(32)).astype(np.uint32)
                parts = [np.sort(small[b:e]) for b, e in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
                blobs = [p[p <= 0xFFFFFFFF >> _level(len(p))].tobytes() for p in parts]
                yield pa.RecordBatch.from_arrays([pa.array(_node(hashes, bounds)[0].view(np.int64)), pa.array(blobs, pa.binary())], ["id", "sample"])

    return run


def _level(n: int) -> int:
    """Halvings that leave at most SAMPLE of n."""
    return max(0, -(-n // SAMPLE) - 1).bit_length()


def _across(least: float, percent: int):
    """One block of a region (rows of own: whether the row belongs to this block, main: to the region's largest component, id,
    component, n, signature, sample) to pairs across components that link as far as samples tell, each in the first order
    only where the two share a region. Rows of two orders may have come to one key by chance; only rows that share an order are
    compared. Pairs of rows outside the main component count in the block of either. Components that a clear pair joins count
    as one from then on, so a block gives few pairs more than it has components. Samples of small sets are whole."""

    def shares(i: int, rest: np.ndarray, n: np.ndarray, samples: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of i and each of rest: the least and the greatest similarity that the samples allow, and the likeliest."""
        low, high, mid = (np.empty(len(rest)) for _ in range(3))
        levels = np.array([_level(int(x)) for x in n[rest]])
        own = _level(int(n[i]))
        for level in np.unique(np.maximum(levels, own)).tolist():
            at = np.flatnonzero(np.maximum(levels, own) == level)
            cut = np.uint32(0xFFFFFFFF >> level)
            mine = samples[i][: np.searchsorted(samples[i], cut, side="right")]
            others = [samples[j][: np.searchsorted(samples[j], cut, side="right")] for j in rest[at].tolist()]
            sizes = np.array([len(x) for x in others])
            flat = np.concatenate(others)
            met = mine[np.minimum(np.searchsorted(mine, flat), len(mine) - 1)] == flat if len(mine) else np.zeros(len(flat), bool)
            ends = np.cumsum(sizes)
            sums = np.concatenate([[0], np.cumsum(met)])
            both = (sums[ends] - sums[ends - sizes]).astype(float)
            either = np.maximum(len(mine) + sizes - both, 1)
            mid[at] = both / either
            slack = 2 * 2 / either if level == 0 else 5 * np.sqrt(0.25 / either)
            low[at], high[at] = mid[at] - slack, mid[at] + slack
        return low, high, mid

    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        region = table.column("region")[0].as_py()
        id_, label, n = (table.column(c).to_numpy().copy() for c in ("id", "component", "n"))
        own, main = (table.column(c).to_numpy() for c in ("own", "main"))
        signatures = _matrix(table.column("signature").chunk(0))
        samples = [np.frombuffer(x, np.uint32) for x in table.column("sample").to_pylist()]
        order = np.argsort(main, kind="stable")  # the largest component comes last
        id_, label, n, own, main, signatures, samples = id_[order], label[order], n[order], own[order], main[order], signatures[order], [samples[i] for i in order.tolist()]
        keys = _keys(signatures)
        here = np.uint64(region % (1 << 64))
        found: list[tuple[int, int]] = []
        for i in range(int((~main).sum())):
            rest = np.flatnonzero((label[i + 1 :] != label[i]) & (percent * n[i + 1 :] <= 100 * n[i]) & (100 * n[i + 1 :] >= percent * n[i]) & (own[i + 1 :] | own[i])) + i + 1
            rest = rest[(signatures[rest] == signatures[i]).mean(axis=1) >= least]
            shared = keys[rest] == keys[i]
            rest = rest[shared.any(axis=1) & (keys[i, shared.argmax(axis=1)] == here)]
            if not len(rest):
                continue
            low, high, mid = shares(i, rest, n, samples)
            for at in np.argsort(-mid, kind="stable").tolist():
                if high[at] < percent / 100:
                    continue
                j = int(rest[at])
                if label[j] != label[i]:
                    found.append((int(id_[i]), int(id_[j])))
                    if low[at] >= percent / 100:
                        label[label == label[j]] = label[i]
        a, b = (np.array([f[k] for f in found], np.int64) for k in range(2))
        return pa.table({"a": pa.array(np.minimum(a, b), pa.int64()), "b": pa.array(np.maximum(a, b), pa.int64())})

    return run


def _sets(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, texts in slices(batch.column(0)):
                hashes, bounds = shingle_sets(texts, k)
                lists = pa.LargeListArray.from_arrays(pa.array(bounds), pa.array(hashes.view(np.int64)))
                yield pa.RecordBatch.from_arrays([pa.array(_node(hashes, bounds)[0].view(np.int64)), lists.cast(pa.list_(pa.int64()))], ["id", "grams"])

    return run


def _texts_of(docs: DataFrame, classes: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Texts that stand for the classes in ids (and perhaps others), and those classes. docs: key, text; classes: id, rep."""
    wanted = saved(classes.join(ids, "id", "left_semi").select("id", "rep"))
    keys = wanted.select(F.col("rep").alias("key")).distinct()
    keys = F.broadcast(keys) if wanted.count() <= BROADCAST_IDS else keys
    return docs.join(keys, "key", "left_semi").select("text"), wanted.select("id")


def _confirmed(docs: DataFrame, classes: DataFrame, pairs: DataFrame, k: int, percent: int) -> DataFrame:
    """The pairs (of classes) whose full sets hold the threshold."""
    texts, ids = _texts_of(docs, classes, pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct())
    sets = saved(texts.mapInArrow(tidy(_sets(k)), "id long, grams array<bigint>").join(ids, "id", "left_semi").dropDuplicates(["id"]))
    one = pairs.join(sets.select(F.col("id").alias("a"), F.col("grams").alias("ga")), "a")
    both = one.join(sets.select(F.col("id").alias("b"), F.col("grams").alias("gb")), "b")
    met = F.size(F.array_intersect("ga", "gb"))
    links = saved(both.filter(100 * met >= percent * (F.size("ga") + F.size("gb") - met)).select("a", "b"))
    dropped(sets)
    return links


def near_duplicates(df: DataFrame, key: str = "doc_id", text: str = "text", k: int = 5, percent: int = 80) -> DataFrame:
    """One row for each row of df: key, n_shingles, component_id (the least key reachable), kept (key = component_id).

    percent: pairs link when 100 * shared shingles >= percent * shingles of either.
    """
    small_batches(df.sparkSession)
    docs = df.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text"))
    least = least_estimate(percent)
    signed = saved(docs.mapInArrow(tidy(_signed(k)), "key long, n long, id long, check long, signature binary"))
    known = signed.filter(F.col("key").isNotNull() & (F.col("n") > 0))
    classes = saved(known.groupBy("id", "check", "n").agg(F.min("key").alias("rep"), F.first("signature").alias("signature")))

    placed = classes.select("id", "signature").mapInArrow(tidy(_placed), "region long, further long, id long")
    in_order = placed.repartition("region").sortWithinPartitions("region", "further", "id")
    crowded = saved(in_order.mapInArrow(tidy(_crowded), "region long, id long, before long"))

    near = crowded.filter(F.col("before").isNotNull()).select(F.least("id", "before").alias("a"), F.greatest("id", "before").alias("b")).filter("a != b").distinct()
    a = classes.select(F.col("id").alias("a"), F.col("signature").alias("sa"))
    b = classes.select(F.col("id").alias("b"), F.col("signature").alias("sb"))
    estimated = near.join(a, "a").join(b, "b").select("a", "b", "sa", "sb").mapInArrow(tidy(_estimated(least)), "a long, b long, estimate double")
    best = F.row_number().over(Window.partitionBy("b").orderBy(F.desc("estimate"), "a"))
    first = saved(estimated.withColumn("__r", best).filter(F.col("__r") <= FIRST_TRIES).select("a", "b"))
    links = _confirmed(docs, classes, first, k, percent)
    merged = components(links)

    labelled = saved(crowded.select("region", "id").join(merged, "id", "left").select("region", "id", F.coalesce("component", "id").alias("component")))
    dropped(crowded)
    kinds = labelled.groupBy("region", "component").agg(F.count(F.lit(1)).alias("rows"))
    open_ = kinds.groupBy("region").agg(F.sum("rows").alias("rows"), F.count(F.lit(1)).alias("kinds"), F.max_by("component", "rows").alias("most")).filter("kinds > 1")
    open_ = saved(open_.select("region", F.ceil(F.col("rows") / REGION_ROWS).cast("int").alias("blocks"), "most", "rows"))
    # Regions of many rows are few (each has HOT_ROWS at least), so their rows needn't meet in one task.
    hot = open_.filter(F.col("rows") > HOT_ROWS)
    hot = F.broadcast(hot) if hot.count() <= BROADCAST_IDS else hot
    calm = labelled.join(open_.filter(F.col("rows") <= HOT_ROWS), "region")
    open_rows = saved(calm.unionByName(labelled.join(hot, "region")).drop("rows"))
    texts, ids = _texts_of(docs, classes, open_rows.select("id").distinct())
    samples = texts.mapInArrow(tidy(_sampled(k)), "id long, sample binary").join(ids, "id", "left_semi").dropDuplicates(["id"])
    known = classes.select("id", "n", "signature").join(samples, "id")
    home = F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")
    placed_rows = open_rows.select("region", "id", "component", (F.col("component") == F.col("most")).alias("main"), home.alias("home"), "blocks")
    everywhere = F.when(F.col("main"), F.array("home")).otherwise(F.sequence(F.lit(0), F.col("blocks") - 1))
    placed_rows = placed_rows.withColumn("block", F.explode(everywhere)).withColumn("own", F.col("block") == F.col("home"))
    members = placed_rows.join(known, "id").select("region", "block", "own", "main", "id", "component", "n", "signature", "sample")
    second = saved(members.groupBy("region", "block").applyInArrow(_across(least, percent), "a long, b long").distinct().join(first, ["a", "b"], "left_anti"))
    dropped(labelled)
    more = _confirmed(docs, classes, second, k, percent)
    final = components(links.unionByName(more))

    # Components of several classes alone need a common name; there are half as many as links at most.
    labels = saved(classes.select("id", "check", "n", "rep").join(final, "id", "left"))
    names = saved(labels.filter(F.col("component").isNotNull()).groupBy("component").agg(F.min("rep").alias("component_id")))
    names = F.broadcast(names) if names.count() <= BROADCAST_IDS else names
    of_class = labels.join(names, "component", "left").select("id", "check", "n", F.coalesce("component_id", "rep").alias("component_id"))
    out = signed.select("key", "n", "id", "check").join(of_class, ["id", "check", "n"], "left")
    component = F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("key"))
    return out.select(F.col("key").alias(key), F.col("n").alias("n_shingles"), F.when(F.col("key").isNotNull(), component).alias("component_id")).withColumn(
        "kept", F.coalesce(F.col(key) == F.col("component_id"), F.lit(True))
    )
