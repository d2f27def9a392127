"""Cost-balanced packing of tokenized documents into training sequences.

A piece of n tokens costs linear * n + quadratic * n * n (attention stays inside a piece). Inside a block of documents, the
number of sequences is known from the number of tokens, so all are opened at once; documents go in descending order to the
sequence of lowest cost that has room for all of it, and one that fits nowhere whole is cut to fill the room of the cheapest. All sequences of a
block are full; what is left over fills sequences whose lengths are powers of two, so nothing is padded.

Blocks are runs of a task's rows, bounded by BLOCK_TOKENS: texts are never shuffled, a task holds one block at a time, and a
retried task gives the same pieces. Words are tokenized once for each cache, not once for each place.

Null or empty text gives the closing id alone. Repeated rows are packed each for itself. An empty table gives an empty table.
Columns other than the key and the text don't pass through, so no names clash.
"""

from __future__ import annotations

import functools
import heapq
import itertools
import operator
import os
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from emberlog.llm.memory import small_batches, tidy

CAPACITY = 2048
#: A block ends at so many tokens or texts of so many bytes; text is tokenized in slices of SLICE_BYTES.
BLOCK_TOKENS, SLICE_BYTES = 2_000_000, 2 << 20
#: At so many words, the tokenizer's cache keeps those used more than once.
CACHE_WORDS = 300_000
END_ID = 1
SEQUENCES_BITS = 36

#: A Latin letter that stays one letter in lower case, and ASCII punctuation other than an apostrophe.
_SEAM = r"([a-zÀ-ÖØ-öø-\x{012F}\x{0131}-\x{017F}])([!-&(-/:-@\[-`{-~])"

#: Words that the tokenizer keeps in one piece, whose last id then is one that ends a word: Latin letters, or punctuation.
_ONE_PIECE = r"^(?:[a-zß-öø-ÿ]+|[!-&(-/:-@\[-`{-~]+)$"


class WordTokenizer:
    """Ids of whole texts, by way of their words, for a tokenizer that drops white space and lower-cases.

    Splitting at white space, and between a Latin letter and ASCII punctuation other than an apostrophe, never splits what such a
    tokenizer would keep together. Texts that hold '<|', and so perhaps a special token, are tokenized whole.
    """

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self._tokenizer = Tokenizer.from_file(path)
        vocabulary = self._tokenizer.get_vocab(with_added_tokens=True)
        self._ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self._ends[[n for token, n in vocabulary.items() if token.endswith("</w>")]] = True
        self._at: dict[str, int] = {}
        self._ids = np.empty(0, np.uint32)
        self._starts = self._lengths = self._hits = np.empty(0, np.int64)

    def _keep_repeated(self) -> None:
        """Empties the cache but for the words that were looked up more than once since they came."""
        words = np.array(list(self._at), object)
        kept = np.flatnonzero(self._hits > 1)
        if len(kept) > CACHE_WORDS // 2:
            kept = kept[:0]
        starts, lengths = self._starts[kept], self._lengths[kept]
        begins = np.cumsum(lengths) - lengths
        self._ids = self._ids[np.repeat(starts - begins, lengths) + np.arange(lengths.sum())]
        self._starts, self._lengths, self._hits = begins, lengths, np.ones(len(kept), np.int64)
        self._at = dict(zip(words[kept].tolist(), range(len(kept)), strict=True))

    def _coded(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """ids of the words one after the other, and how many each word has."""
        simple = pc.match_substring_regex(pa.array(words, pa.large_string()), _ONE_PIECE).to_numpy(zero_copy_only=False)
        if simple.all():
            lines = [" ".join(words[i : i + 256]) for i in range(0, len(words), 256)]
            ids = np.concatenate([np.array(x.ids, np.uint32) for x in self._tokenizer.encode_batch_fast(lines, add_special_tokens=False)])
            ends = np.flatnonzero(self._ends[ids])
            if len(ends) == len(words) and ends[-1] == len(ids) - 1:
                return ids, np.diff(ends, prepend=-1)
        each = [x.ids for x in self._tokenizer.encode_batch_fast(words, add_special_tokens=False)]
        return np.fromiter(itertools.chain.from_iterable(each), np.uint32), np.fromiter(map(len, each), np.int64, len(each))

    def _known(self, words: list[str]) -> np.ndarray:
        """The place of each word in the cache, which gets those that it lacks."""
        if len(self._at) + len(words) > CACHE_WORDS and self._at:
            self._keep_repeated()
        fresh = [w for w in words if w not in self._at]
        if fresh:
            simple = pc.match_substring_regex(pa.array(fresh, pa.large_string()), _ONE_PIECE).to_pylist()
            for part in (list(itertools.compress(fresh, simple)), list(itertools.compress(fresh, map(operator.not_, simple)))):
                for at in range(0, len(part), 20_000):
                    some = part[at : at + 20_000]
                    ids, lengths = self._coded(some)
                    n = len(self._at)
                    self._starts = np.concatenate([self._starts, len(self._ids) + np.cumsum(lengths) - lengths])
                    self._lengths = np.concatenate([self._lengths, lengths])
                    self._hits = np.concatenate([self._hits, np.zeros(len(some), np.int64)])
                    self._ids = np.concatenate([self._ids, ids])
                    self._at.update(zip(some, range(n, n + len(some)), strict=True))
        places = np.fromiter(map(self._at.__getitem__, words), np.int64, len(words))
        self._hits[places] += 1
        return places

    def __call__(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """ids of all texts one after the other (uint32), and where each text's ids start (one more at the end)."""
        texts = pc.fill_null(texts.cast(pa.large_string()), "").take(pa.array(np.arange(len(texts))))  # string kernels misread slices
        special = pc.match_substring(texts, "<|").to_numpy(zero_copy_only=False)
        plain = pc.if_else(pa.array(special), "", texts) if special.any() else texts
        split = pc.replace_substring_regex(pc.ascii_lower(plain), pattern=_SEAM, replacement=r"\1 \2")
        lists = pc.ascii_split_whitespace(split)
        words = lists.flatten()
        filled = pc.not_equal(pc.binary_length(words), 0).to_numpy(zero_copy_only=False)
        coded = words.dictionary_encode()
        place = self._known(coded.dictionary.to_pylist())[coded.indices.to_numpy()] if len(words) else np.empty(0, np.int64)
        starts, lengths = self._starts, self._lengths
        sizes = np.where(filled, lengths[place], 0) if len(words) else np.empty(0, np.int64)
        ends = np.concatenate([[0], np.cumsum(sizes)])
        offsets = lists.offsets.to_numpy()
        offsets = offsets - offsets[0]
        ids = self._ids[np.repeat(starts[place] - ends[:-1], sizes) + np.arange(ends[-1])] if len(words) else np.empty(0, np.uint32)
        bounds = ends[offsets]
        if not special.any():
            return ids, bounds
        parts = [ids[bounds[i] : bounds[i + 1]] for i in range(len(texts))]
        for i in np.flatnonzero(special):
            parts[i] = np.array(self._tokenizer.encode(texts[int(i)].as_py(), add_special_tokens=False).ids, np.uint32)
        return np.concatenate(parts), np.concatenate([[0], np.cumsum([len(p) for p in parts])])


@functools.lru_cache(maxsize=1)
def _words(path: str) -> WordTokenizer:
    """One for each worker process, so that tasks share its cache."""
    return WordTokenizer(path)


def lengths_of(total: int, capacity: int = CAPACITY) -> list[int]:
    """Full sequences, then powers of two for the rest."""
    rest = total % capacity
    return [capacity] * (total // capacity) + [1 << b for b in reversed(range(rest.bit_length())) if rest >> b & 1]


class _Rooms:
    """Open sequences by the room they have: a heap of (cost, sequence) for each room, under a tree of the least of them."""

    def __init__(self, capacity: int) -> None:
        self._leaves = 1 << capacity.bit_length()
        self._heaps: list[list[tuple[float, int]]] = [[] for _ in range(capacity + 1)]
        self._least: list[tuple[float, int, int]] = [_NONE] * (2 * self._leaves)

    def _settle(self, room: int) -> None:
        at, heap, tree = room + self._leaves, self._heaps[room], self._least
        tree[at] = (*heap[0], room) if heap else _NONE
        at >>= 1
        while at:
            a, b = tree[2 * at], tree[2 * at + 1]
            best = a if a <= b else b
            if tree[at] == best:
                break
            tree[at] = best
            at >>= 1

    def push(self, cost: float, sequence: int, room: int) -> None:
        heapq.heappush(self._heaps[room], (cost, sequence))
        self._settle(room)

    def pop(self, need: int) -> tuple[float, int] | None:
        """The sequence of least cost that has room for need, or None."""
        at = need + self._leaves
        best = self._least[at]
        while at > 1:
            if not at & 1:
                best = min(best, self._least[at + 1])
            at >>= 1
        if best[1] < 0:
            return None
        heapq.heappop(self._heaps[best[2]])
        self._settle(best[2])
        return best[:2]


_NONE = (float("inf"), -1, -1)


def assign(sizes: np.ndarray, capacity: int = CAPACITY, linear: float = 1.0, quadratic: float = 1 / 512) -> Iterator[tuple[int, int, int, int, int]]:
    """(document, start, length, sequence, offset) for each piece; sizes: tokens of each document, in descending order."""
    rooms = lengths_of(int(sizes.sum()), capacity)
    full = int(sizes.sum()) // capacity
    open_ = _Rooms(capacity)
    for s in range(full):
        open_.push(0.0, s, capacity)
    small = list(reversed(range(full, len(rooms))))
    used = [0] * len(rooms)
    for document, size in enumerate(sizes.tolist()):
        start = 0
        while start < size:
            found = open_.pop(min(size - start, capacity)) or open_.pop(1)
            cost, s = found if found else (0.0, small[-1])
            n = min(size - start, rooms[s] - used[s])
            yield document, start, n, s, used[s]
            used[s] += n
            start += n
            if s < full:
                if used[s] < rooms[s]:
                    open_.push(cost + linear * n + quadratic * n * n, s, rooms[s] - used[s])
            elif used[s] == rooms[s]:
                small.pop()


def _slices(texts: pa.Array) -> Iterator[pa.Array]:
    at, sizes = 0, np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False))
    while at < len(texts):
        end = max(at + 1, int(np.searchsorted(sizes, (sizes[at - 1] if at else 0) + SLICE_BYTES)))
        yield texts.slice(at, end - at)
        at = end


SCHEMA = "start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"


def _packer(tokenizer: str, capacity: int, end_id: int, kind: pa.DataType, linear: float, quadratic: float) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        context = TaskContext.get()
        first = (context.partitionId() if context else 0) << SEQUENCES_BITS
        words, keys, parts, sizes, held = _words(tokenizer), [], [], [], 0

        def block() -> Iterator[pa.RecordBatch]:
            nonlocal first, keys, parts, sizes, held
            if not parts:
                return
            ids, n = np.concatenate(parts), np.concatenate(sizes)
            key = pa.concat_arrays(keys)
            begins = np.concatenate([[0], np.cumsum(n)[:-1]])
            order = np.lexsort((np.arange(len(n)), np.array(pc.rank(key, tiebreaker="first")), -n))
            pieces = np.array(list(assign(n[order], capacity, linear, quadratic)), np.int64).reshape(-1, 5)
            sequences = len(lengths_of(int(n.sum()), capacity))
            for at in range(0, len(pieces), 4000):
                p = pieces[at : at + 4000]
                d = order[p[:, 0]]
                blobs = [ids[b : b + m].astype("<u4").tobytes() for b, m in zip((begins[d] + p[:, 1]).tolist(), p[:, 2].tolist(), strict=True)]
                columns = [key.take(pa.array(d)), *(pa.array(c) for c in (p[:, 1], p[:, 2])), pa.array(blobs, pa.binary()), *(pa.array(c) for c in (n[d], first + p[:, 3], p[:, 4]))]
                yield pa.RecordBatch.from_arrays(columns, ["__key", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"])
            first += sequences
            keys, parts, sizes, held = [], [], [], 0

        for batch in batches:
            done = 0
            for texts in _slices(batch.column(1)):
                ids, bounds = words(texts)
                n = np.diff(bounds) + 1
                whole = np.full(len(ids) + len(texts), end_id, np.uint32)
                ends = np.cumsum(n) - 1
                keep = np.ones(len(whole), bool)
                keep[ends] = False
                whole[keep] = ids
                keys.append(batch.column(0).slice(done, len(texts)).cast(kind))
                parts.append(whole)
                sizes.append(n)
                done += len(texts)
                held += len(whole)
                if held >= BLOCK_TOKENS:
                    yield from block()
        yield from block()

    return pack


def pack(df: DataFrame, tokenizer: str, key: str = "doc_id", text: str = "text", capacity: int = CAPACITY, end_id: int = END_ID, linear: float = 1.0, quadratic: float = 1 / 512) -> DataFrame:
    """One row for each piece: key, start (its document's ids before it), length, ids (little-endian unsigned 32-bit),
    doc_tokens (with end_id), sequence_id and offset (its place there, gapless from 0). tokenizer: a file's path on the workers."""
    from pyspark.sql.pandas.types import to_arrow_type

    small_batches(df.sparkSession)
    field = df.schema[key]
    run = _packer(tokenizer, capacity, end_id, to_arrow_type(field.dataType), linear, quadratic)
    slim = df.select(df[key].alias("__key"), df[text].alias("__text"))
    return slim.mapInArrow(tidy(run), f"__key {field.dataType.simpleString()}, {SCHEMA}").withColumnRenamed("__key", key)
