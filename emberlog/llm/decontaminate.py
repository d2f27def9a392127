"""Benchmark decontamination with a BM25 index of the test items and block-max WAND.

Test items are indexed by their words; an item's BM25 weights are divided by its score against itself, so one threshold
serves all items. Every passage of every text is a query: windows of twice the longest item, a new one at each such length,
so each copy lies whole in one window. Bounds are used as in WAND and block-max WAND, for all windows of a batch at once:

1. An item's light words together weigh at most SLACK, so a window can only reach the threshold if the item's heavy words in
   it weigh the rest; the heavy words' lists alone are read for all windows.
2. For the windows left, each block of items is bounded by the sum of the words' largest weights in that block.
3. Items in blocks that may reach the threshold are scored in full.

What scores high is verified: of the five-word shingles (fewer words: the whole sequence) of the item, and of its question
and its answer (the last sentence) apart, enough must stand in the window.

Words are runs of ASCII letters and digits and of all non-ASCII characters, A-Z in lower case. Null text counts as empty;
items without words are never found; repeated items and documents are reported each for itself; empty tables give an empty
table. Columns other than keys and texts don't pass through.

Document frequencies, the average length and the longest item are those of the whole benchmark. The index is built in parts of
PART_ITEMS items, so a task holds one part at a time: texts are read and split into words once, in slices, and each slice
meets the parts one after the other. The rows are the same for any size of a part.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberlog.llm.memory import small_batches, tidy
from emberlog.llm.scratch import ROW, dropped, numbered, saved
from emberlog.llm.shingles import SLICE_BYTES, slices

K1, B = 1.2, 0.75
#: Share of an item's score against itself that a passage must reach.
THRESHOLD = 0.5
#: Words of an item that together weigh at most so much of it aren't looked up at first.
SLACK = 0.25
BLOCK_ITEMS, PART_ITEMS = 16, 20_000
SHINGLE, OVERLAP = 5, 0.8

_TABLE = np.array([c + 32 if 65 <= c <= 90 else c if c >= 128 or chr(c).isalnum() else 32 for c in range(256)], np.uint8)


def _spaced(texts: pa.Array) -> pa.Array:
    """The texts with A-Z in lower case and spaces for ASCII characters that belong to no word; texts: a large_string copy."""
    _, offsets, data = texts.buffers()
    if data is None:
        return texts
    ends = np.frombuffer(offsets, np.int64)[: len(texts) + 1]
    changed = _TABLE[np.frombuffer(data, np.uint8)[: ends[-1]]]
    return pa.LargeStringArray.from_buffers(len(texts), offsets, pa.py_buffer(changed))


def words_of(text: str | None) -> list[str]:
    return [w for w in (text or "").encode().translate(_TABLE.tobytes()).decode().split(" ") if w]


def question_and_answer(text: str | None) -> tuple[list[str], list[str]]:
    """Words of an item without its last sentence, and of that; an item of one sentence is all question."""
    parts = [p for p in re.split(r"(?<=[.!?])\s+|\n+", (text or "").strip()) if words_of(p)]
    if len(parts) < 2:
        return words_of(text), []
    answer = words_of(parts[-1])
    return words_of(text)[: -len(answer)], answer


def shingles(words: tuple | list, k: int = SHINGLE) -> set[tuple]:
    if not words:
        return set()
    return {tuple(words[i : i + k]) for i in range(len(words) - k + 1)} if len(words) >= k else {tuple(words)}


class Index:
    """Inverted lists of items with BM25 weights, their heavy part, and block maxima."""

    def __init__(self, items: list[tuple[int, str]], known: Counter | dict | None = None, n: int = 0, average: float = 0.0, longest: int = 0) -> None:
        """known: for each word, in how many items of the benchmark it stands; n, average and longest: how many items there are
        and how many words they have. Without known, these are taken from items."""
        items = [(i, t) for i, t in items if words_of(t)]
        self.ids = [i for i, _ in items]
        texts = [words_of(t) for _, t in items]
        if known is None:
            known, n, average, longest = Counter(w for t in texts for w in set(t)), len(texts), sum(map(len, texts)) / max(len(texts), 1), max(map(len, texts), default=1)
        self.terms = sorted({w for t in texts for w in t})
        number = {w: i for i, w in enumerate(self.terms)}
        coded = [[number[w] for w in t] for t in texts]
        frequency = [known[w] for w in self.terms]
        rows = []
        for item, words in enumerate(coded):
            weights = {}
            for w, here in Counter(words).items():
                idf = np.log(1 + (n - frequency[w] + 0.5) / (frequency[w] + 0.5))
                weights[w] = idf * here * (K1 + 1) / (here + K1 * (1 - B + B * len(words) / average))
            whole, light = sum(weights.values()), 0.0
            for w, x in sorted(weights.items(), key=lambda p: (p[1], p[0])):
                light += x / whole
                rows.append((w, item, x / whole, light > SLACK))
        rows.sort()
        term = np.array([r[0] for r in rows], np.int64)
        self.item, self.weight = np.array([r[1] for r in rows], np.int64), np.array([r[2] for r in rows])
        self.bounds = np.searchsorted(term, np.arange(len(self.terms) + 1))
        heavy = np.array([r[3] for r in rows], bool)
        self.heavy_item, self.heavy_weight = self.item[heavy], self.weight[heavy]
        self.heavy_bounds = np.searchsorted(term[heavy], np.arange(len(self.terms) + 1))
        blocks: dict[tuple[int, int], float] = {}
        for w, item, x, _ in rows:
            at = (w, item // BLOCK_ITEMS)
            blocks[at] = max(blocks.get(at, 0.0), x)
        self.block = np.array([b for _, b in blocks], np.int64)
        self.block_weight = np.array(list(blocks.values()))
        self.block_bounds = np.searchsorted(np.array([w for w, _ in blocks], np.int64), np.arange(len(self.terms) + 1))
        self.stride = max(longest, 1)
        self.parts = []
        for _, text in items:
            question, answer = question_and_answer(text)
            self.parts.append([shingles([number[w] for w in x]) for x in (words_of(text), question, answer)])

    def found(self, words: np.ndarray) -> dict[int, tuple[float, float, float]]:
        """Items of one window: score, overlap of the question and of the answer. words: term numbers, -1 for others."""
        terms = np.unique(words[words >= 0])
        block = _lists(self.block_bounds, terms)
        live = np.bincount(self.block[block], self.block_weight[block]) >= THRESHOLD
        if not live.any():
            return {}
        at = _lists(self.bounds, terms)
        items = self.item[at]
        kept = live[items // BLOCK_ITEMS]
        scores = np.bincount(items[kept], self.weight[at][kept])
        out, here = {}, None
        for item in np.flatnonzero(scores >= THRESHOLD).tolist():
            if here is None:
                here = words.tolist()
            share = [len([s for s in p if _stands(s, here)]) / len(p) if p else 1.0 for p in self.parts[item]]
            if share[0] >= OVERLAP or min(share[1:]) >= OVERLAP:
                out[item] = (float(scores[item]), share[1], share[2])
        return out


def _stands(shingle: tuple, words: list[int]) -> bool:
    at = -1
    while True:
        try:
            at = words.index(shingle[0], at + 1)
        except ValueError:
            return False
        if tuple(words[at : at + len(shingle)]) == shingle:
            return True


def _lists(bounds: np.ndarray, terms: np.ndarray) -> np.ndarray:
    """Places of all entries of the terms' lists."""
    starts, sizes = bounds[terms], bounds[terms + 1] - bounds[terms]
    return np.repeat(starts - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())


def _candidates(index: Index, words: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Windows (text, first word) in which the heavy words of an item weigh enough."""
    stride = index.stride
    sizes = np.diff(bounds)
    windows = np.maximum(-(-sizes // stride), 1)
    base = np.cumsum(windows) - windows
    heavy = np.flatnonzero((words >= 0) & (np.diff(index.heavy_bounds)[words] > 0))
    text = np.searchsorted(bounds, heavy, side="right") - 1
    place = (heavy - bounds[text]) // stride
    window = base[text] + place
    found = []
    for part in range(0, len(heavy), 400_000):
        cut = slice(part, part + 400_000)
        at = _lists(index.heavy_bounds, words[heavy[cut]])
        lengths = np.diff(index.heavy_bounds)[words[heavy[cut]]]
        w, first = np.repeat(window[cut], lengths), np.repeat(place[cut] == 0, lengths)
        found.append((w * len(index.ids) + index.heavy_item[at], index.heavy_weight[at], first))
    if not found:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    key, weight, first = (np.concatenate(x) for x in zip(*found, strict=True))
    # A word stands in the window that starts in its stretch and, but for a text's first stretch, in the one before.
    before = ~first
    keys = np.concatenate([key, key[before] - len(index.ids)])
    weights = np.concatenate([weight, weight[before]])
    cells = int(windows.sum()) * len(index.ids)
    if cells <= 40_000_000:
        heavy_enough = np.flatnonzero(np.bincount(keys, weights, minlength=1) >= THRESHOLD - SLACK)
    else:
        kinds, inverse = np.unique(keys, return_inverse=True)
        heavy_enough = kinds[np.bincount(inverse, weights) >= THRESHOLD - SLACK]
    chosen = np.unique(heavy_enough // len(index.ids))
    text = np.searchsorted(base, chosen, side="right") - 1
    return text, bounds[text] + (chosen - base[text]) * stride


_SCHEMA = "doc_id long, item_id long, score double, question_overlap double, answer_overlap double"


_held: tuple[int, Index, pa.Array] | None = None  # the part that this worker met last


def _index(part) -> tuple[Index, pa.Array]:
    """The index of a broadcast part, kept until another one is asked for."""
    global _held
    if _held is None or _held[0] != part.id:
        _held = None
        rows, n, average, longest = part.value
        known = {w: c for _, _, counts in rows for w, c in counts.items()}
        index = Index([(i, t) for i, t, _ in rows], known, n, average, longest)
        _held = (part.id, index, pa.array(index.terms, pa.large_string()))
        part.unpersist_local()
    return _held[1:]


class _Part:
    """A broadcast part; its rows leave the worker's memory once they are indexed."""

    def __init__(self, broadcast, number: int) -> None:
        self._broadcast, self.id = broadcast, number

    @property
    def value(self):
        return self._broadcast.value

    def unpersist_local(self) -> None:
        self._broadcast.__dict__.pop("_value", None)


def _searcher(parts: list[_Part]):
    # With several parts, an index is built anew for each slice, so slices are larger.
    most = SLICE_BYTES if len(parts) == 1 else 8 * SLICE_BYTES

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, texts in slices(batch.column(1), most):
                lists = pc.ascii_split_whitespace(_spaced(texts))
                flat = lists.flatten()
                if not len(flat):
                    continue
                offsets = lists.offsets.to_numpy() - lists.offsets[0].as_py()
                coded = flat.dictionary_encode()
                filled = pc.not_equal(pc.binary_length(flat), 0).to_numpy(zero_copy_only=False)
                bounds = np.concatenate([[0], np.cumsum(filled)])[offsets]
                indices = coded.indices.to_numpy()[filled]
                for part in parts:
                    index, terms = _index(part)
                    if not index.ids:
                        continue
                    known = pc.fill_null(pc.index_in(coded.dictionary, value_set=terms), -1).to_numpy(zero_copy_only=False).astype(np.int64)
                    words = known[indices]
                    best: dict[tuple[int, int], tuple[float, float, float]] = {}
                    for text, start in zip(*(x.tolist() for x in _candidates(index, words, bounds)), strict=True):
                        for item, hit in index.found(words[start : min(start + 2 * index.stride, int(bounds[text + 1]))]).items():
                            best[text, item] = max(best.get((text, item), hit), hit)
                    if best:
                        keys = batch.column(0).slice(at, len(texts)).cast(pa.int64()).take(pa.array([t for t, _ in best]))
                        scores = [pa.array([v[i] for v in best.values()], pa.float64()) for i in range(3)]
                        yield pa.RecordBatch.from_arrays([keys, pa.array([index.ids[i] for _, i in best], pa.int64()), *scores], ["doc_id", "item_id", "score", "question_overlap", "answer_overlap"])

    return run


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """id, text to id, text and the item's words."""
    for batch in batches:
        words = pa.array([words_of(t) for t in batch.column(1).to_pylist()], pa.list_(pa.string()))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), words], ["id", "text", "words"])


def _parts(benchmark: DataFrame) -> Iterator[tuple]:
    """(rows, n, average, longest): rows are PART_ITEMS items (id, text, document frequency of its words); the rest is of all items."""
    items = benchmark.mapInArrow(_counted, "id long, text string, words array<string>").filter(F.size("words") > 0).withColumn("at", F.monotonically_increasing_id())
    items = saved(items)
    n, average, longest = items.agg(F.count(F.lit(1)), F.avg(F.size("words")), F.max(F.size("words"))).first()
    word = items.select("at", F.explode(F.array_distinct("words")).alias("word"))
    counts = word.groupBy("word").agg(F.count(F.lit(1)).alias("c"))
    # A word of many items would fill one task of this join; AQE splits it, as it does any skewed join.
    of_item = word.join(counts, "word").groupBy("at").agg(F.map_from_entries(F.collect_list(F.struct("word", "c"))).alias("counts"))
    rows = []
    for row in items.select("at", "id", "text").join(of_item, "at").orderBy("id", "text").toLocalIterator():
        rows.append((row["id"], row["text"], row["counts"]))
        if len(rows) == PART_ITEMS:
            yield rows, n, average, longest
            rows = []
    if rows or not n:
        yield rows, n, average or 1.0, longest or 1
    dropped(items)


def contaminated(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text") -> DataFrame:
    """One row for each document and item found in it: key, item_id, score (1 or more for a whole copy), question_overlap,
    answer_overlap (shares of their shingles; an answer without words counts as found)."""
    small_batches(docs.sparkSession)
    context = docs.sparkSession.sparkContext
    slim = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    items = benchmark.select(F.col(item).cast("long").alias("id"), F.col(item_text).alias("text"))
    parts = [context.broadcast(part) for part in _parts(items)]
    return slim.mapInArrow(tidy(_searcher([_Part(b, b._jbroadcast.id()) for b in parts])), _SCHEMA).withColumnRenamed("doc_id", key)


def decontaminate(docs: DataFrame, benchmark: DataFrame, text: str = "text", broadcast_ids: int = 4_000_000) -> DataFrame:
    """docs without the rows whose text holds an item, whatever their keys; row ids are broadcast if they are few enough, else shuffled."""
    rows = numbered(docs)
    hits = saved(contaminated(rows, benchmark, ROW, text).select(ROW).distinct())
    few = hits.count() <= broadcast_ids
    return rows.join(F.broadcast(hits) if few else hits, ROW, "left_anti").select(*docs.columns)
