"""Repeated passages: bytes covered by a string of LENGTH bytes that starts anywhere else, too.

All strings that may repeat are put in order by external induced sorting (see emberlog.llm.induced), whose common prefixes tell
which ones do. Before that, strings are dealt to shards, and those that can't repeat, or do so plainly, are left out:

1. Winnowing gives each string of LENGTH bytes one anchor: of the GRAM-byte strings in it, the one of least hash. Equal
   strings have equal anchors, so each shard can be sorted by itself. Runs of strings with one anchor make a fragment: about
   280 bytes for each 77.
2. Fragments meet by the anchor's hash. An anchor that stands once settles its fragment: nothing in it repeats. Equal
   fragments (by a second hash of all their bytes) settle each other: all in them repeats.
3. What is left - fragments that share an anchor but differ, mostly where copies begin, end or were edited - goes to shards
   by anchor, each different fragment once. A shard is read as it comes, so it can be larger than memory: beyond a bound its
   text, its queues and its tables lie in files of the task. Suffixes that are neighbours in its order with a common prefix of
   LENGTH bytes repeat.

Anchors on many fragments are told first; their rows are pre-aggregated by fragment and never meet in one task. Texts are known
by a 64-bit hash, and a second one tells different texts that share it, which then go by the second; texts that stand twice
repeat whole. Texts are read and hashed where they lie; only the texts that keep fragments for step 3 or lose bytes are
shuffled. No text, fragment list or link reaches the driver.

Null text counts as empty; texts under LENGTH bytes keep all; repeated rows are copies of each other; empty tables give
empty tables. Columns other than the key and the text don't pass through.
"""

from __future__ import annotations

import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from emberlog.llm.induced import Disk, descending_suffixes
from emberlog.llm.memory import released, small_batches, tidy
from emberlog.llm.scratch import dropped, saved
from emberlog.llm.shingles import mixed, slices

LENGTH, GRAM = 200, 48
#: Bytes of text whose hashes a task holds at once, and bytes of fragments in a shard on average.
CHUNK_BYTES, SHARD_BYTES = 1 << 19, 12 << 20
#: Anchors on more fragments than this, or than a millionth of all, are hot; there are so few that they can be broadcast.
HOT_ROWS = 2000
#: Anchors with more different fragments than this tell their fragments apart by further anchors.
CROWD = 4096
#: Ids are broadcast to pick texts if they are at most so many; beyond that the texts are shuffled to them.
BROADCAST_IDS = 4_000_000
#: Salt of the second hash of a text.
SECOND = 0x5EC0
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the hash base and of its inverse, modulo 2**64."""
    up, down = np.full(n, _BASE, np.uint64), np.full(n, _INVERSE, np.uint64)
    up[:1] = down[:1] = 1
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


_TABLE = mixed(np.arange(1, 257, dtype=np.uint64), 0x51ED270B) | np.uint64(1)
_UP, _DOWN = powers(CHUNK_BYTES + 2 * LENGTH)


def _windows(least: np.ndarray, width: int) -> np.ndarray:
    """The minimum of each run of width values."""
    n = len(least)
    blocks = -(-n // width)
    padded = np.full(blocks * width, np.iinfo(np.uint64).max, np.uint64)
    padded[:n] = least
    padded = padded.reshape(blocks, width)
    forward = np.minimum.accumulate(padded, axis=1).ravel()
    backward = np.minimum.accumulate(padded[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(backward[: n - width + 1], forward[width - 1 : n])


def fragments(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, ...]:
    """data: bytes of texts one after the other; ends: of each text. For each fragment: anchor hash, fragment hash, text,
    first string's place in the text, number of strings."""
    out = []
    starts = np.concatenate([[0], ends[:-1]])
    width = LENGTH - GRAM + 1
    pieces = []  # (text, first byte, bytes): texts, and parts of texts that are longer than a chunk
    for text in np.flatnonzero(ends - starts >= LENGTH).tolist():
        for at in range(int(starts[text]), int(ends[text]) - LENGTH + 1, CHUNK_BYTES):
            pieces.append((text, at, min(CHUNK_BYTES + LENGTH - 1, int(ends[text]) - at)))
    at = 0
    while at < len(pieces):
        last, total = at, 0
        while last < len(pieces) and (last == at or total + pieces[last][2] <= CHUNK_BYTES):
            total += pieces[last][2]
            last += 1
        part = pieces[at:last]
        at = last
        sizes = np.array([p[2] for p in part])
        chunk = np.concatenate([data[p[1] : p[1] + p[2]] for p in part])
        begins = np.cumsum(sizes) - sizes
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_TABLE[chunk] * _UP[: len(chunk)], dtype=np.uint64)])
        grams = mixed((sums[GRAM:] - sums[:-GRAM]) * _DOWN[: len(chunk) - GRAM + 1])
        packed = grams >> np.uint64(24) << np.uint64(24) | np.arange(len(grams), dtype=np.uint64)
        anchor = (_windows(packed, width) & np.uint64(0xFFFFFF)).astype(np.int64)
        valid = np.zeros(len(anchor) + 1, bool)
        for b, size in zip(begins.tolist(), sizes.tolist(), strict=True):
            valid[b : b + size - LENGTH + 1] = True
        place = np.flatnonzero(valid[:-1])
        which = np.searchsorted(begins, place, side="right") - 1
        fresh = np.concatenate([[True], (anchor[place][1:] != anchor[place][:-1]) | (which[1:] != which[:-1])])
        first = place[fresh]
        count = np.diff(np.append(np.flatnonzero(fresh), len(place)))
        spot = anchor[first]
        whole = mixed((sums[first + count + LENGTH - 1] - sums[first]) * _DOWN[first], 0x77) + mixed((spot - first).astype(np.uint64), 0x99)
        text = np.array([p[0] for p in part])[which[fresh]]
        offset = np.array([p[1] for p in part])[which[fresh]] - starts[text] - begins[which[fresh]]
        out.append((grams[spot].view(np.int64), whole.view(np.int64), text, first + offset, count))
    if not out:
        return tuple(np.empty(0, np.int64) for _ in range(5))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def _bytes_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    _, offsets, data = texts.buffers()
    ends = np.frombuffer(offsets, np.int64)[: len(texts) + 1]
    return np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8), ends[1:]


def _found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """t, text to fragments; a text that the task has met is left out, as are most copies so before any shuffle."""
    met: set[int] = set()
    for batch in batches:
        for at, texts in slices(batch.column(1), 8 * CHUNK_BYTES):
            ids = batch.column(0).slice(at, len(texts)).to_pylist()
            keep = []
            for i, t in enumerate(ids):
                if t not in met:
                    keep.append(i)
                    if len(met) < 1_000_000:
                        met.add(t)
            data, ends = _bytes_of(texts.take(pa.array(keep, pa.int64())))
            anchor, whole, text, first, count = fragments(data, ends)
            t = np.array(ids, np.int64)[np.array(keep, np.int64)][text] if keep else text
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (anchor, whole, t)] + [pa.array(first, pa.int64()), pa.array(count, pa.int32())], ["anchor", "whole", "t", "first", "n"])


def further_anchors(data: np.ndarray) -> list[tuple[int, int, int]]:
    """(place, number, key) of runs of strings in a fragment's bytes that have the same two further anchors; equal strings
    have equal keys."""
    width = LENGTH - GRAM + 1
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_TABLE[data] * _UP[: len(data)], dtype=np.uint64)])
    grams = (sums[GRAM:] - sums[:-GRAM]) * _DOWN[: len(data) - GRAM + 1]
    places, key = [], np.zeros(len(data) - LENGTH + 1, np.uint64)
    for salt in (0x2545F491, 0x4F6CDD1D):
        hashes = mixed(grams, salt)
        packed = hashes >> np.uint64(24) << np.uint64(24) | np.arange(len(grams), dtype=np.uint64)
        at = (_windows(packed, width) & np.uint64(0xFFFFFF)).astype(np.int64)
        places.append(at)
        key = mixed(key + hashes[at], salt)
    cuts = np.flatnonzero((places[0][1:] != places[0][:-1]) | (places[1][1:] != places[1][:-1])) + 1
    starts = np.concatenate([[0], cuts])
    return list(zip(starts.tolist(), np.diff(np.append(starts, len(key))).tolist(), key[starts].view(np.int64).tolist(), strict=True))


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """text and its wanted fragments to their bytes: those of crowded anchors in parts. grouped: by what they go to shards."""
    names = ["anchor", "whole", "offset", "grouped", "bytes"]
    for batch in batches:
        for text, wanted in zip(batch.column(0), batch.column(1), strict=True):
            data = (text.as_py() or "").encode()
            rows = []
            for r in wanted.as_py():
                blob = data[r["first"] : r["first"] + r["n"] + LENGTH - 1]
                parts = further_anchors(np.frombuffer(blob, np.uint8)) if r["crowded"] else [(0, r["n"], 0)]
                rows += [(r["anchor"], r["whole"], at, r["anchor"] ^ key, blob[at : at + n + LENGTH - 1]) for at, n, key in parts]
            for at in range(0, len(rows), 5000):
                columns = list(zip(*rows[at : at + 5000], strict=True))
                yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in columns[:4]), pa.array(columns[4], pa.binary())], names)


class _Shard:
    """The text of a shard - its parts, 2 added to each byte, with a 1 behind each - and what the parts are, as they come."""

    def __init__(self) -> None:
        self.disk = Disk()
        self._parts: list[np.ndarray] = []
        self._held, self._file, self.size = 0, None, 0
        self.names: list[tuple[np.ndarray, ...]] = []

    def add(self, names: tuple[np.ndarray, ...], parts: pa.Array) -> None:
        """names: arrays that tell the parts; parts: binary."""
        sizes = pc.binary_length(parts).to_numpy(zero_copy_only=False).astype(np.int64)
        begins = np.cumsum(sizes + 1) - sizes - 1
        text = np.ones(int((sizes + 1).sum()), np.uint8)
        inside = np.ones(len(text), bool)
        inside[begins + sizes] = False
        text[inside] = np.frombuffer(b"".join(parts.to_pylist()), np.uint8) + 2  # UTF-8 has no byte over 244
        self.names.append((*names, self.size + begins, sizes))
        self._parts.append(text)
        self.size += len(text)
        self._held += len(text)
        if self._held > self.disk.most:
            self._file = self._file or tempfile.TemporaryFile()
            for x in self._parts:
                x.tofile(self._file)
            self._parts, self._held = [], 0

    def text(self) -> np.ndarray:
        parts, self._parts = [*self._parts, np.zeros(1, np.uint8)], []
        if self._file is None:
            return np.concatenate(parts)
        for x in parts:
            x.tofile(self._file)
        self._file.flush()
        return np.memmap(self._file, np.uint8, "r", shape=(self.size + 1,))

    def repeated(self) -> Iterator[tuple[np.ndarray, ...]]:
        """names, lo and hi of the maximal stretches covered by strings of LENGTH bytes that start in two places of the shard."""
        if not self.names:
            return
        names = [np.concatenate(x) for x in zip(*self.names, strict=True)]
        begins, sizes = names[-2:]
        twice = self.disk.room(self.size + 1, bool)
        last = None
        for places, common in descending_suffixes(self.text(), 256, self.disk):
            at = np.flatnonzero(common >= LENGTH)
            twice[places[at]] = True
            twice[places[at[at > 0] - 1]] = True
            if len(at) and at[0] == 0:
                twice[last] = True
            last = places[-1]
        carried = None  # the last stretch so far, which may go on: part, first and last string
        for k in range(0, len(twice), CHUNK_BYTES):
            place = np.flatnonzero(twice[k : k + CHUNK_BYTES]) + k
            part = np.searchsorted(begins, place, side="right") - 1
            whole = place + LENGTH <= begins[part] + sizes[part]  # other strings reach over the end of their part
            place, part = place[whole], part[whole]
            if not len(place):
                continue
            fresh = np.concatenate([[True], (part[1:] != part[:-1]) | (place[1:] - place[:-1] > LENGTH)])
            starts = np.flatnonzero(fresh)
            ends = np.append(starts[1:], len(place)) - 1
            stretch = np.stack([part[starts], place[starts], place[ends]])
            if carried is not None:
                if stretch[0, 0] == carried[0, 0] and stretch[1, 0] - carried[2, 0] <= LENGTH:
                    stretch[1, 0] = carried[1, 0]
                else:
                    stretch = np.concatenate([carried, stretch], axis=1)
            stretch, carried = stretch[:, :-1], stretch[:, -1:]
            yield self._told(names, stretch)
        if carried is not None:
            yield self._told(names, carried)

    @staticmethod
    def _told(names: list[np.ndarray], stretch: np.ndarray) -> tuple[np.ndarray, ...]:
        part, first, last = stretch
        begin = names[-2][part]
        return (*(x[part] for x in names[:-2]), first - begin, last + LENGTH - begin)


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The union as maximal stretches; those that touch become one."""
    out: list[tuple[int, int]] = []
    for lo, hi in sorted(spans):
        if out and lo <= out[-1][1]:
            if hi > out[-1][1]:
                out[-1] = (out[-1][0], hi)
        else:
            out.append((lo, hi))
    return out


def _sorted_shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (shard, anchor, whole, offset, bytes) in order of shards to anchor, whole, lo, hi of stretches that repeat."""

    def told(shard: _Shard) -> Iterator[pa.RecordBatch]:
        for anchor, whole, offset, lo, hi in shard.repeated():
            if len(lo):
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (anchor, whole, offset + lo, offset + hi)], ["anchor", "whole", "lo", "hi"])
        released()

    shard, at = _Shard(), None
    for batch in batches:
        numbers = batch.column(0).to_numpy()
        cuts = [0, *(np.flatnonzero(numbers[1:] != numbers[:-1]) + 1).tolist(), len(numbers)]
        for b, e in zip(cuts[:-1], cuts[1:], strict=True) if len(numbers) else ():
            if at is not None and numbers[b] != at:
                yield from told(shard)
                shard = _Shard()
            at = numbers[b]
            shard.add(tuple(batch.column(i).slice(b, e - b).to_numpy() for i in (1, 2, 3)), batch.column(4).slice(b, e - b))
    yield from told(shard)


def _met(found: DataFrame) -> DataFrame:
    """Fragments that share their anchor: anchor, whole, t, first, n, copies (1: it stands once), mixed (other fragments have that
    anchor, too), fetch (this row stands for its fragment in a shard) and crowded (many do).

    Rows are dealt by anchor. Those of hot anchors are dealt by fragment, and those of hot fragments by place; what these need
    to know of each other comes from partial sums that are broadcast, as hot anchors and fragments are few.
    """
    rows = max(HOT_ROWS, found.count() // 1_000_000)
    hot = found.groupBy("anchor").agg(F.count(F.lit(1)).alias("c")).filter(F.col("c") > rows).select("anchor", F.lit(True).alias("hot"))
    told = found.join(F.broadcast(hot), "anchor", "left")
    if_hot = lambda c: F.when(F.col("hot"), F.col(c)).alias(c)
    pairs = told.groupBy(if_hot("anchor"), if_hot("whole")).agg(
        F.count(F.lit(1)).alias("rows"), F.min("t").alias("t0"), F.max("t").alias("t1"), F.min("first").alias("f0"), F.max("first").alias("f1"), F.min_by("first", "t").alias("at")
    )
    pairs = saved(pairs.filter("anchor IS NOT NULL"))
    kinds = pairs.groupBy("anchor").agg(F.count(F.lit(1)).alias("kinds"))
    large = pairs.filter(F.col("rows") > rows).select("anchor", "whole", "t0", "at", ((F.col("t0") != F.col("t1")) | (F.col("f0") != F.col("f1"))).alias("twice"))
    known = found.join(F.broadcast(kinds), "anchor", "left").join(F.broadcast(large), ["anchor", "whole"], "left")
    deal = F.when(F.col("twice").isNotNull(), F.xxhash64("anchor", "whole", "t", "first")).when(F.col("kinds").isNotNull(), F.xxhash64("anchor", "whole")).otherwise(F.col("anchor"))
    dealt = known.withColumn("deal", deal).repartition("deal").dropDuplicates(["deal", "anchor", "whole", "t", "first", "n"])
    anchors, wholes = Window.partitionBy("deal", "anchor"), Window.partitionBy("deal", "anchor", "whole")
    met = dealt.withColumns(
        {
            "mixed": F.when(F.col("kinds").isNotNull(), F.col("kinds") > 1).otherwise(F.min("whole").over(anchors) != F.max("whole").over(anchors)),
            "copies": F.when(F.col("twice").isNotNull(), F.when(F.col("twice"), 2).otherwise(1)).otherwise(F.count(F.lit(1)).over(wholes)),
        }
    ).filter(F.col("mixed") | (F.col("copies") > 1))
    one = F.when(F.col("twice").isNotNull(), (F.col("t") == F.col("t0")) & (F.col("first") == F.col("at"))).otherwise(F.row_number().over(wholes.orderBy("t", "first")) == 1)
    met = met.withColumn("fetch", F.col("mixed") & one)
    crowded = F.coalesce(F.col("kinds"), F.sum(F.col("fetch").cast("int")).over(anchors)) > CROWD
    return saved(met.withColumn("crowded", crowded).select("anchor", "whole", "t", "first", "n", "copies", "mixed", "fetch", "crowded"))


def repeated_spans(docs: DataFrame) -> DataFrame:
    """docs: t (names the text), text. Rows of t, lo, hi: covered stretches of texts that stand once or more (not merged)."""
    found = saved(docs.select("t", "text").mapInArrow(tidy(_found), "anchor long, whole long, t long, first long, n int"))
    met = _met(found)
    settled = met.filter(F.col("copies") > 1).select("t", F.col("first").alias("lo"), (F.col("first") + F.col("n") + LENGTH - 1).alias("hi"))
    fetch, lone = met.filter("fetch"), met.filter(F.col("mixed") & (F.col("copies") == 1)).select("anchor", "whole", "t", "first")
    shards = max(1, -(-fetch.count() * (LENGTH + 80) // SHARD_BYTES))
    wanted = saved(fetch.groupBy("t").agg(F.collect_list(F.struct("anchor", "whole", "first", "n", "crowded")).alias("wanted")))
    texts = picked(docs.select("t", "text"), wanted.select("t")).dropDuplicates(["t"])
    pieces = texts.join(wanted, "t").select("text", "wanted").mapInArrow(tidy(_cut), "anchor long, whole long, offset long, grouped long, bytes binary")
    shard = F.pmod(F.xxhash64("grouped"), F.lit(shards)).cast("int").alias("shard")
    dealt = pieces.select(shard, "anchor", "whole", "offset", "bytes").repartition("shard").sortWithinPartitions("shard")
    covers = dealt.mapInArrow(tidy(_sorted_shards), "anchor long, whole long, lo long, hi long")
    edges = lone.join(covers, ["anchor", "whole"]).select("t", (F.col("first") + F.col("lo")).alias("lo"), (F.col("first") + F.col("hi")).alias("hi"))
    return settled.unionByName(edges)


def picked(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """docs whose t is among ids."""
    few = ids.count() <= BROADCAST_IDS
    return docs.join(F.broadcast(ids) if few else ids, "t", "left_semi")


def _kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """key, text, spans to key, kept bytes and the maximal stretches removed."""
    for batch in batches:
        for at in range(0, batch.num_rows, 200):
            part = batch.slice(at, 200)
            rows = []
            for text, spans in zip(part.column(1).to_pylist(), part.column(2).to_pylist(), strict=True):
                data, cuts = (text or "").encode(), merged([(s["lo"], s["hi"]) for s in spans])
                bounds = [0, *(x for c in cuts for x in c), len(data)]
                rows.append((b"".join(data[bounds[i] : bounds[i + 1]] for i in range(0, len(bounds), 2)), [{"lo": a, "hi": b} for a, b in cuts]))
            yield pa.RecordBatch.from_arrays(
                [part.column(0), pa.array([r[0] for r in rows], pa.binary()), pa.array([r[1] for r in rows], pa.list_(pa.struct([("lo", pa.int64()), ("hi", pa.int64())])))], ["key", "kept", "removed"]
            )


def _copies(docs: DataFrame) -> DataFrame:
    """t of texts that stand twice, with the least and greatest of their second hashes."""
    return saved(docs.filter(F.col("n") >= LENGTH).groupBy("t").agg(F.count(F.lit(1)).alias("c"), F.min("u").alias("lo"), F.max("u").alias("hi")).filter("c > 1"))


def remove_repeats(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each row of df: key, n_bytes, kept (binary, what is left) and removed (array of struct<lo, hi>, bytes)."""
    small_batches(df.sparkSession)
    whole = F.coalesce(F.col(text), F.lit(""))
    docs = df.select(F.col(key).alias("key"), whole.alias("text"), F.xxhash64(whole).alias("t"), F.xxhash64(F.lit(SECOND), whole).alias("u"), F.octet_length(whole).cast("long").alias("n"))
    copies = _copies(docs)
    shared = copies.filter("lo <> hi").select("t")
    if not shared.isEmpty():
        # Different texts of one hash, a handful in billions, go by their second one.
        docs = docs.join(F.broadcast(shared.withColumn("__shared", F.lit(True))), "t", "left").withColumn("t", F.when(F.col("__shared"), F.col("u")).otherwise(F.col("t"))).drop("__shared")
        copies = _copies(docs)
    copies = copies.select("t")
    docs = docs.drop("u")
    spans = saved(repeated_spans(docs))
    marked = saved(spans.join(copies, "t", "left_anti").groupBy("t").agg(F.collect_list(F.struct("lo", "hi")).alias("spans")))
    dropped(spans)
    state = copies.withColumn("state", F.lit(2)).unionByName(marked.select("t", F.lit(1).alias("state")))
    state = F.broadcast(state) if state.count() <= BROADCAST_IDS else state
    told = docs.join(state, "t", "left")
    none = F.array().cast("array<struct<lo: bigint, hi: bigint>>")
    clean = told.filter(F.col("state").isNull()).select("key", "n", F.encode("text", "UTF-8").alias("kept"), none.alias("removed"))
    gone = told.filter("state = 2").select("key", "n", F.lit(b"").alias("kept"), F.array(F.struct(F.lit(0).cast("long").alias("lo"), F.col("n").alias("hi"))).alias("removed"))
    partly = picked(docs, marked.select("t")).join(marked, "t").select("key", "text", "spans")
    kind = df.schema[key].dataType.simpleString()
    cut = partly.mapInArrow(tidy(_kept), f"key {kind}, kept binary, removed array<struct<lo: bigint, hi: bigint>>")
    cut = cut.select("key", (F.octet_length("kept") + F.aggregate("removed", F.lit(0).cast("long"), lambda a, s: a + s["hi"] - s["lo"])).cast("long").alias("n"), "kept", "removed")
    return clean.unionByName(gone).unionByName(cut).select(F.col("key").alias(key), F.col("n").alias("n_bytes"), "kept", "removed")
