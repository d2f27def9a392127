"""Masks for training: text infilling and gap sentences.

Gap sentences by independent scores are plain columns. Infilling and sequential selection go step by step inside one document
and run in tasks, one document at a time, each with a generator seeded by the seed and the document.
"""

from __future__ import annotations

import bisect
import itertools
import math
from collections import Counter
from collections.abc import Callable, Hashable, Iterator, Sequence
from typing import Protocol

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from emberlog.operators.metrics import stem, stemmed

Sentences = Sequence[Sequence]


class Masker(Protocol):
    """What a mask is: mask() hides, antimask() shows what mask() hides and hides the rest."""

    def mask(self, sentences: Sentences) -> list[list]: ...

    def antimask(self, sentences: Sentences) -> list[list]: ...


class Draws:
    """Lengths and positions for infilling; give them to repeat known ones."""

    def __init__(self, seed: int | None = None, mean: float = 3.0, lengths: Sequence[int] = (), positions: Sequence[int] = ()) -> None:
        self._rng, self._mean = np.random.default_rng(seed), mean
        self._lengths, self._positions = list(lengths), list(positions)

    def length(self) -> int:
        return self._lengths.pop(0) if self._lengths else int(self._rng.poisson(self._mean))

    def position(self, n: int) -> int:
        return self._positions.pop(0) if self._positions else int(self._rng.integers(0, n))


def _end(to: list[int], i: int) -> int:
    """Where the way from i ends; the way there is halved."""
    while to[i] != i:
        to[i] = to[to[i]]
        i = to[i]
    return i


class TextInfilling:
    """Spans of tokens become one mask each until a share of all tokens is hidden; a span of no length puts a mask before a
    token, which then stays.

    Sentences are one row of tokens with an end after each. A span starts at a position in that row and takes the tokens from
    there on that are still free; if those don't suffice, it takes free ones before it, too, and its mask stands at the first.
    """

    def __init__(self, ratio: float = 0.3, mean: float = 3.0, seed: int | None = None, mask_token="<mask>") -> None:
        self.ratio, self.mean, self.seed, self.mask_token = min(max(ratio, 0.0), 1.0), mean, seed, mask_token

    def _spans(self, sentences: Sentences, draws: Draws, zero_keeps: bool):
        """The places that each span takes, or for one of no length its place alone and False."""
        n = sum(map(len, sentences)) + len(sentences)
        # The next free place from each on, and the last one up to each (shifted by one), found by ways that shorten as they are gone.
        after, before, at = list(range(n + 1)), list(range(n + 1)), 0
        take = lambda i: (after.__setitem__(i, i + 1), before.__setitem__(i + 1, i))
        for s in sentences:
            at += len(s) + 1
            take(at - 1)
        budget = math.ceil(sum(map(len, sentences)) * self.ratio)
        while budget > 0:
            length = min(budget, draws.length())
            at = draws.position(n)
            budget -= length
            if length == 0:
                if zero_keeps:
                    take(at)
                yield [at], False
                continue
            taken, earlier = [], []
            while len(taken) < length and (i := _end(after, at)) < n:
                taken.append(i)
                take(i)
            while len(taken) + len(earlier) < length and (i := _end(before, at)) > 0:
                earlier.append(i - 1)
                take(i - 1)
            taken = earlier[::-1] + taken
            if taken:
                yield taken, True

    @staticmethod
    def _sentences(cells: list[list]) -> list[list]:
        out, now = [], []
        for token in (t for c in cells for t in c):
            if token is None:
                out.append(now)
                now = []
            else:
                now.append(token)
        return out

    def mask(self, sentences: Sentences, draws: Draws | None = None) -> list[list]:
        cells = [[t] for s in sentences for t in (*s, None)]
        for places, real in self._spans(sentences, draws or Draws(self.seed, self.mean), True):
            for i in places if real else ():
                cells[i] = []
            cells[places[0]].insert(0, self.mask_token)
        return self._sentences(cells)

    def antimask(self, sentences: Sentences, draws: Draws | None = None) -> list[list]:
        """The tokens of the spans alone, a mask for each other token."""
        row = [t for s in sentences for t in (*s, None)]
        shown = {i for places, real in self._spans(sentences, draws or Draws(self.seed, self.mean), False) if real for i in places}
        return self._sentences([[t if t is None or i in shown else self.mask_token] for i, t in enumerate(row)])


def unigram_f1(candidate: Sequence, rest: Sequence) -> float:
    """F1 of shared token counts."""
    a, b = Counter(candidate), Counter(rest)
    shared = sum((a & b).values())
    return 2 * shared / (len(candidate) + len(rest)) if shared else 0.0


def count_to_mask(n: int, ratio: float) -> int:
    """Half to even."""
    return round(n * ratio)


def ngram_f1(candidate: Sequence, rest: Sequence, n: int = 1) -> float:
    """F1 of shared runs of n tokens."""
    a, b = (Counter(zip(*(x[i:] for i in range(n)), strict=False)) for x in (candidate, rest))
    shared, total = sum((a & b).values()), sum(a.values()) + sum(b.values())
    return 2 * shared / total if shared else 0.0


class _Text:
    """Some of a document's sentences in order, as one row of tokens, with counts of its runs of n tokens, also across ends."""

    def __init__(self, sentences: Sentences, n: int, members: Sequence[int] = ()) -> None:
        self._sentences, self._n, self._members = sentences, n, list(members)
        self.counts = self._runs([t for i in self._members for t in sentences[i]])

    def _runs(self, tokens: Sequence) -> Counter:
        return Counter(zip(*(tokens[i:] for i in range(self._n)), strict=False))

    def change(self, i: int, coming: bool) -> Counter:
        """What sentence i would add to the counts by coming, or take away (below zero) by going; sentences around it that are short
        let runs reach over several of them."""
        at, near = bisect.bisect_left(self._members, i), self._n - 1
        left, right = [], []
        for k in reversed(self._members[:at]) if near else ():
            left = [*self._sentences[k], *left][-near:]
            if len(left) == near:
                break
        for k in itertools.islice(self._members, at + (not coming), None) if near else ():
            right = [*right, *self._sentences[k]][:near]
            if len(right) == near:
                break
        change = self._runs([*left, *self._sentences[i], *right])
        change.subtract(self._runs([*left, *right]))
        return change if coming else Counter({g: -c for g, c in change.items()})

    def apply(self, i: int, change: Counter, coming: bool) -> None:
        self.counts.update(change)
        if coming:
            bisect.insort(self._members, i)
        else:
            self._members.remove(i)


def _selected(sentences: Sentences, n: int, picks: int, sequential: bool) -> set[int]:
    """The sentences with the best F1 of runs of n tokens against the rest of the document: each by itself, or together with those
    picked before it. Counts run along, so a round costs the document's tokens once, whatever n is."""
    if any(not isinstance(t, Hashable) for s in sentences for t in s):
        sentences = [[repr(t) for t in s] for s in sentences]
    if n == 1:
        return _selected_by_tokens(sentences, picks, sequential)
    inside, rest = _Text(sentences, n), _Text(sentences, n, range(len(sentences)))
    shared, total = 0, sum(rest.counts.values())
    picked: set[int] = set()

    def scored(i: int) -> tuple[float, int, Counter, Counter]:
        comes, goes = inside.change(i, True), rest.change(i, False)
        gain = sum(min(inside.counts[g] + comes[g], rest.counts[g] + goes[g]) - min(inside.counts[g], rest.counts[g]) for g in {**comes, **goes})
        size = total + sum(comes.values()) + sum(goes.values())
        return (2 * (shared + gain) / size if shared + gain else 0.0), gain, comes, goes

    if not sequential:
        scores = [scored(i)[0] for i in range(len(sentences))]
        return set(sorted(range(len(sentences)), key=lambda i: (-scores[i], i))[:picks])
    for _ in range(picks):
        found = {i: scored(i) for i in range(len(sentences)) if i not in picked}
        best = max(f[0] for f in found.values())
        tied = [i for i, f in found.items() if f[0] == best]
        chosen = next((i for i in tied if len(sentences[i])), tied[-1])
        _, gain, comes, goes = found[chosen]
        shared, total = shared + gain, total + sum(comes.values()) + sum(goes.values())
        inside.apply(chosen, comes, True)
        rest.apply(chosen, goes, False)
        picked.add(chosen)
    return picked


def _selected_by_tokens(sentences: Sentences, picks: int, sequential: bool) -> set[int]:
    """_selected() for runs of one token: no run reaches over a sentence's end and the size of both sides together stays, so the best
    F1 is that of most shared tokens; a round adds up arrays."""
    number: dict[Hashable, int] = {}
    of = np.array([number.setdefault(t, len(number)) for s in sentences for t in s], np.int64)
    at = np.repeat(np.arange(len(sentences)), [len(s) for s in sentences])
    pairs, counts = np.unique(at * max(len(number), 1) + of, return_counts=True)
    at, of = pairs // max(len(number), 1), pairs % max(len(number), 1)
    inside, rest = np.zeros(len(number), np.int64), np.bincount(of, counts, len(number)).astype(np.int64)
    gains = lambda: np.bincount(at, np.minimum(inside[of] + counts, rest[of] - counts) - np.minimum(inside[of], rest[of]), len(sentences)).astype(float)
    if not sequential:
        return set(np.argsort(-gains(), kind="stable")[:picks].tolist())
    picked: set[int] = set()
    for _ in range(picks):
        gain = gains()
        gain[list(picked)] = -np.inf
        tied = np.flatnonzero(gain == gain.max()).tolist()
        chosen = next((i for i in tied if len(sentences[i])), tied[-1])
        mine = slice(*np.searchsorted(at, [chosen, chosen + 1]))
        inside[of[mine]] += counts[mine]
        rest[of[mine]] -= counts[mine]
        picked.add(chosen)
    return picked


class GapSentences:
    """The sentences that tell most of the others become one mask each. select: 'independent' or 'sequential'.

    Sentences are scored by the F1 of runs of n tokens, of their stems if stems is set, or by a score of (candidate, rest) of the
    caller's own, which then is called for every candidate of every round.
    """

    def __init__(self, ratio: float = 0.3, select: str = "independent", score: Callable[[Sequence, Sequence], float] | None = None, mask_token="<*>", context: bool = True, n: int = 1, stems: bool = False) -> None:
        self.ratio, self.select, self.score, self.mask_token, self.context, self.n, self.stems = ratio, select, score, mask_token, context, n, stems

    def chosen(self, sentences: Sentences) -> set[int]:
        picks = count_to_mask(len(sentences), self.ratio)
        forms = [[stem(str(t).lower()) for t in s] for s in sentences] if self.stems else [list(s) for s in sentences]
        if self.score is None:
            return _selected(forms, self.n, picks, self.select == "sequential")
        if self.select == "independent":
            scores = [self.score(s, [t for j, o in enumerate(forms) if j != i for t in o]) for i, s in enumerate(forms)]
            return set(sorted(range(len(forms)), key=lambda i: (-scores[i], i))[:picks])
        picked: set[int] = set()
        while len(picked) < picks:
            free = [i for i in range(len(forms)) if i not in picked]
            scores = {}
            for i in free:
                inside = [t for j in sorted(picked | {i}) for t in forms[j]]
                scores[i] = self.score(inside, [t for j in free if j != i for t in forms[j]])
            best = max(scores.values())
            tied = [i for i in free if scores[i] == best]
            picked.add(next((i for i in tied if len(forms[i])), tied[-1]))
        return picked

    def both(self, sentences: Sentences) -> tuple[list[list], list[list]]:
        """mask() and antimask() of one choice."""
        picked = self.chosen(sentences)
        return self.mask(sentences, picked), self.antimask(sentences, picked)

    def mask(self, sentences: Sentences, picked: set[int] | None = None) -> list[list]:
        picked = self.chosen(sentences) if picked is None else picked
        return [[self.mask_token] if i in picked else list(s) for i, s in enumerate(sentences)]

    def antimask(self, sentences: Sentences, picked: set[int] | None = None) -> list[list]:
        picked = self.chosen(sentences) if picked is None else picked
        if self.context:
            return [list(s) for i, s in enumerate(sentences) if i in picked]
        return [list(s) if i in picked else [self.mask_token] * len(s) for i, s in enumerate(sentences)]


#: Presets.
PRESETS = {
    "text-infilling": lambda seed=None: TextInfilling(0.3, 3.0, seed),
    "gap-independent": lambda seed=None: GapSentences(0.3, "independent"),
    "gap-sequential": lambda seed=None: GapSentences(0.3, "sequential"),
    "gap-independent-stems": lambda seed=None: GapSentences(0.3, "independent", stems=True),
    "gap-sequential-stems": lambda seed=None: GapSentences(0.3, "sequential", stems=True),
}


#: Documents of which a task holds masks or scores at once.
SLICE = 500


def _both(masker: Masker, parts: list[list]) -> tuple[list[list], list[list]]:
    return masker.both(parts) if isinstance(masker, GapSentences) else (masker.mask(parts), masker.antimask(parts))


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(0, batch.num_rows, SLICE):
            yield batch.slice(i, SLICE)


def _lists(column: pa.Array) -> list[list[list]]:
    """The sentences of each document; each different token becomes a Python string once."""
    sizes = lambda c: pc.fill_null(pc.list_value_length(c), 0).to_numpy(zero_copy_only=False).tolist()
    parts = column.flatten()
    coded = pc.dictionary_encode(parts.flatten())
    names = [*coded.dictionary.to_pylist(), None]
    codes = pc.fill_null(coded.indices, len(names) - 1).to_numpy(zero_copy_only=False).tolist()
    tokens = iter([names[c] for c in codes])
    sentences = iter([list(itertools.islice(tokens, n)) for n in sizes(parts)])
    return [list(itertools.islice(sentences, n)) for n in sizes(column)]


def masked_documents(docs: DataFrame, sentences: str, key: str, masker: Masker | str, seed: int = 0) -> DataFrame:
    """key, masked and antimasked (array<array<string>>) of each document; sentences: array<array<string>>."""
    texts = pa.list_(pa.list_(pa.string()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches):
            masked, antimasked = [], []
            for k, value in zip(batch.column(0).to_pylist(), _lists(batch.column(1)), strict=True):
                one = PRESETS[masker](seed=seed ^ (int(k) & 0x7FFFFFFF)) if isinstance(masker, str) else masker
                hidden, shown = _both(one, value)
                masked.append(hidden)
                antimasked.append(shown)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(masked, texts), pa.array(antimasked, texts)], [key, "masked", "antimasked"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, sentences).mapInArrow(run, f"{key} {kind}, masked array<array<string>>, antimasked array<array<string>>")


def document_scores(docs: DataFrame, key: str, sentences: str, at: str = "at", stems: bool = False) -> DataFrame:
    """independent_scores() of documents that come whole, one in a row with their sentences (array<array<string>>): key, at (from 0)
    and score of each sentence, counted inside the tasks, without a shuffle."""
    tokens = F.col(sentences)
    if stems:
        tokens = F.transform(tokens, lambda s: stemmed(F.transform(s, F.lower)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches):
            sizes = lambda c: pc.fill_null(pc.list_value_length(c), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            docs_ = batch.column(1)
            in_doc, parts = sizes(docs_), docs_.flatten()
            in_part, words = sizes(parts), parts.flatten()
            doc = np.repeat(np.arange(len(in_doc)), in_doc)
            place = np.arange(len(doc)) - np.repeat(np.cumsum(in_doc) - in_doc, in_doc)
            known = pc.is_valid(words).to_numpy(zero_copy_only=False)
            coded = pc.dictionary_encode(words)
            many = max(len(coded.dictionary), 1)
            codes = pc.fill_null(coded.indices, 0).to_numpy(zero_copy_only=False).astype(np.int64)
            pairs, counts = np.unique((np.repeat(np.arange(len(doc)), in_part) * many + codes)[known], return_counts=True)
            part, code = pairs // many, pairs % many
            _, inverse = np.unique(doc[part] * many + code, return_inverse=True)
            others = np.bincount(inverse, counts)[inverse] - counts if len(counts) else counts
            shared = np.bincount(part, np.minimum(counts, others), len(doc))
            total = np.bincount(doc, in_part, len(in_doc))[doc]
            score = np.where(shared > 0, 2 * shared / np.maximum(total, 1), 0.0)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(doc)), pa.array(place.astype(np.int32)), pa.array(score)], [key, at, "score"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, tokens.alias(sentences)).mapInArrow(run, f"`{key}` {kind}, `{at}` int, score double")


def independent_scores(rows: DataFrame, key: str, at: str, tokens: str, stems: bool = False) -> DataFrame:
    """key, at and score of each sentence (row): unigram F1 against the rest of its document, by counts alone; of the stems of words
    in lower case, if stems is set."""
    if stems:
        rows = rows.withColumn(tokens, stemmed(F.transform(tokens, F.lower)))
    w = Window.partitionBy(key)
    counted = rows.select(key, at, F.size(tokens).alias("__n"), F.explode_outer(tokens).alias("__t")).groupBy(key, at, "__n", "__t").agg(F.count("__t").alias("__c"))
    whole = counted.withColumn("__all", F.sum("__c").over(Window.partitionBy(key, "__t")))
    shared = whole.groupBy(key, at, "__n").agg(F.sum(F.least(F.col("__c"), F.col("__all") - F.col("__c"))).alias("__s"))
    total = shared.withColumn("__total", F.sum("__n").over(w))
    return total.select(key, at, F.when(F.col("__s") > 0, 2 * F.col("__s") / F.col("__total")).otherwise(F.lit(0.0)).alias("score"))


def chosen_by_score(scores: DataFrame, key: str, at: str, ratio: float, score: str = "score") -> DataFrame:
    """Adds chosen: the first round(n * ratio) (half to even) by score, then place."""
    n = F.count(F.lit(1)).over(Window.partitionBy(key))
    rank = F.row_number().over(Window.partitionBy(key).orderBy(F.desc(score), at))
    return scores.withColumn("chosen", rank <= F.bround(n * F.lit(ratio), 0))


def random_scores(rows: DataFrame, key: str, at: str, seed: int = 0) -> DataFrame:
    """key, at and a score that a seeded hash gives: random picks that any engine repeats."""
    text = F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string"), F.col(at).cast("string"))
    return rows.select(key, at, F.conv(F.substring(F.md5(text.cast("binary")), 1, 8), 16, 10).cast("double").alias("score"))


def gap_masked(rows: DataFrame, chosen: Column, text: str, mask_token: str = "<*>") -> DataFrame:
    """Adds masked: the mask for chosen rows, else the text."""
    return rows.withColumn("masked", F.when(chosen, F.lit(mask_token)).otherwise(F.col(text)))


def training_pairs(docs: DataFrame, sentences: str, key: str, masker: Masker | str, encode: Callable[[str], int], separator: int, sentence_max: int | None = None, seed: int = 0, mask_id: int = 1, ignored: int = -100) -> DataFrame:
    """key, input_ids and labels of each document: masked tokens as ids, a separator after each sentence; what the mask hides
    as labels, ignored for masks and separators. sentence_max: tokens of a sentence that count."""
    mask_token = "\u0000mask"

    ids = pa.list_(pa.int32())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches):
            inputs, labels, known = [], [], {}

            def code(t: str, other: int) -> int:
                if t == mask_token:
                    return other
                if t not in known:
                    known[t] = encode(t)
                return known[t]

            for k, value in zip(batch.column(0).to_pylist(), _lists(batch.column(1)), strict=True):
                one = PRESETS[masker](seed=seed ^ (int(k) & 0x7FFFFFFF)) if isinstance(masker, str) else masker
                one.mask_token = mask_token
                hidden, shown = _both(one, [s[:sentence_max] for s in value])
                inputs.append([i for s in hidden for i in (*(code(t, mask_id) for t in s), separator)])
                labels.append([i for s in shown for i in (*(code(t, ignored) for t in s), ignored)])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(inputs, ids), pa.array(labels, ids)], [key, "input_ids", "labels"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, sentences).mapInArrow(run, f"{key} {kind}, input_ids array<int>, labels array<int>")
