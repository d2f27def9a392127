"""Suffixes in order, with their common prefixes, by external induced sorting.

A suffix is falling if it is greater than the one after it, else rising; a turn is a rising suffix after a falling one. The
order of the turns is found first, by recursion: their stretches (from turn to turn) are sorted by a rough induction, named in
that order, and the text of names, which has half as many places at most, is sorted in the same way. From the order of the
turns that of the falling suffixes is induced in an ascending scan, and from theirs that of the rising ones in a descending
scan. Each scan takes tuples (first character, place, common prefix with the one before) from a queue in the order of their
characters and gives each one's left neighbour, as a tuple, back to the queue. The common prefix of two neighbours is one more
than the least between the suffixes that they were induced from, so common prefixes are carried through all scans and, by
way of the stretches' lengths, through the recursion, which ends where the names that are left fit in memory.

Queues hold ranges of characters; ranges wait in memory up to a bound for all of them, and beyond it in a temporary file. The
text, names and places of turns lie in mapped files beyond that bound, too. So memory is bounded whatever the length of the
text: by the bound, and by a few runs of SPAN tuples. Files belong to the running task and go with it; a task that is lost is
run again from its input.
"""

from __future__ import annotations

import tempfile
from collections.abc import Iterator

import numpy as np

#: Bytes of waiting tuples, or of one array, that are held in memory.
QUEUE_BYTES = 72 << 20
#: Tuples that are sorted or scanned at once.
SPAN = 1 << 18
#: Ranges of a queue are smaller by so much.
SPLIT = 4
#: Bytes of memory for each name in which a text of names is sorted; the recursion ends where that fits.
NAME_BYTES = 48
#: Common prefixes are told up to so many characters.
MOST_COMMON = 255


class Disk:
    """What runs hold in memory together, and a file for the rest."""

    def __init__(self, most: int | None = None) -> None:
        self.most = QUEUE_BYTES if most is None else most
        self.spilled, self.depth, self._held, self._file, self.runs = 0, 0, 0, None, []

    def grown(self, by: int) -> None:
        self._held += by
        if self._held > self.most:
            self._file = self._file or tempfile.TemporaryFile()
            for run in self.runs:
                run.spill()
            self._held = 0

    def write(self, array: np.ndarray) -> tuple[int, int, np.dtype]:
        at = self._file.seek(0, 2)
        array.tofile(self._file)
        self.spilled += array.nbytes
        return at, len(array), array.dtype

    def read(self, at: int, n: int, kind: np.dtype) -> np.ndarray:
        self._file.seek(at)
        return np.fromfile(self._file, kind, n)

    def room(self, n: int, kind) -> np.ndarray:
        """An array of zeros, in a file of its own if it is large."""
        if n * np.dtype(kind).itemsize <= self.most:
            return np.zeros(n, kind)
        self.spilled += n * np.dtype(kind).itemsize
        return np.memmap(tempfile.TemporaryFile(), kind, "w+", shape=(n,))


class Run:
    """Tuples, as several arrays of one length, in the order in which they came."""

    def __init__(self, disk: Disk) -> None:
        self._disk, self._parts, self.size = disk, [], 0
        disk.runs.append(self)

    def add(self, *arrays: np.ndarray) -> None:
        if len(arrays[0]):
            self._parts.append(arrays)
            self.size += len(arrays[0])
            self._disk.grown(sum(a.nbytes for a in arrays))

    def spill(self) -> None:
        self._parts = [tuple(self._disk.write(a) if isinstance(a, np.ndarray) else a for a in part) for part in self._parts]

    def _read(self, parts: list) -> tuple[np.ndarray, ...]:
        read = []
        for part in parts:
            for a in part:
                self._disk.grown(-a.nbytes if isinstance(a, np.ndarray) else 0)
            read.append([a if isinstance(a, np.ndarray) else self._disk.read(*a) for a in part])
        return tuple(np.concatenate(x) for x in zip(*read, strict=True))

    def taken(self, backwards: bool = False) -> Iterator[tuple[np.ndarray, ...]]:
        """Chunks of the run, which is empty then; backwards: the last part first, each part in its own order."""
        parts, self._parts, self.size = self._parts, [], 0
        parts = parts[::-1] if backwards else parts
        held, n = [], 0
        for part in parts:
            held.append(part)
            n += len(part[0]) if isinstance(part[0], np.ndarray) else part[0][1]
            if n >= SPAN // 4:
                yield self._read(held[::-1] if backwards else held)
                held, n = [], 0
        if held:
            yield self._read(held[::-1] if backwards else held)

    def closed(self) -> None:
        self._parts = []
        self._disk.runs.remove(self)


class Queue:
    """Tuples (character, place, common prefix) by ranges of characters."""

    def __init__(self, counts: np.ndarray, disk: Disk) -> None:
        """counts: of each character; a range has about SPAN / SPLIT tuples, or one character that has more."""
        size = max(SPAN // SPLIT, 1)
        heavy = counts > size
        group = (np.cumsum(counts) - counts) // size
        cut = np.ones(len(counts), bool)
        cut[1:] = (group[1:] != group[:-1]) | heavy[1:] | heavy[:-1]
        self.edges = np.append(np.flatnonzero(cut), len(counts))
        self._runs = [Run(disk) for _ in range(len(self.edges) - 1)]
        self._loose: list[tuple[np.ndarray, ...]] = []
        self._waiting = 0

    def push(self, characters: np.ndarray, places: np.ndarray, common: np.ndarray) -> None:
        if len(places):
            self._loose.append((characters, places, common))
            self._waiting += len(places)
            if self._waiting >= SPAN:
                self._deal()

    def _deal(self) -> None:
        if not self._loose:
            return
        characters, places, common = (np.concatenate(x) for x in zip(*self._loose, strict=True))
        self._loose, self._waiting = [], 0
        which = np.searchsorted(self.edges, characters, side="right") - 1
        order = np.argsort(which.astype(np.uint16) if len(self.edges) < 65_000 else which, kind="stable")
        which, characters, places, common = which[order], characters[order], places[order], common[order]
        cuts = np.concatenate([[0], np.flatnonzero(which[1:] != which[:-1]) + 1, [len(which)]]).tolist()
        for b, e in zip(cuts[:-1], cuts[1:], strict=True):
            self._runs[which[b]].add(characters[b:e].copy(), places[b:e].copy(), common[b:e].copy())

    def taken(self, i: int) -> Iterator[tuple[np.ndarray, ...]]:
        self._deal()
        return self._runs[i].taken()

    def closed(self) -> None:
        for run in self._runs:
            run.closed()


class _Seeds:
    """Chunks of tuples in order of their characters, taken up to a character."""

    def __init__(self, chunks: Iterator[tuple[np.ndarray, ...]]) -> None:
        self._chunks, self._now = chunks, None

    def below(self, character: int) -> Iterator[tuple[np.ndarray, ...]]:
        while True:
            if self._now is None or not len(self._now[0]):
                self._now = next(self._chunks, None)
                if self._now is None:
                    return
            cut = int(np.searchsorted(self._now[0], character))
            if not cut:
                return
            part, self._now = tuple(a[:cut] for a in self._now), tuple(a[cut:] for a in self._now)
            yield part


def _joined(parts: list, like: tuple) -> tuple[np.ndarray, ...]:
    return tuple(np.concatenate(x) for x in zip(like, *parts, strict=True))


def _least(values: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """The least of values[first..last] for each pair (ends included)."""
    levels = (np.frexp((last - first + 1).astype(np.float64))[1] - 1).astype(np.int64)
    table, n = [values], len(values)
    for k in range(int(levels.max()) if len(levels) else 0):
        above = table[-1].copy()
        half = 1 << k
        np.minimum(table[-1][: n - half], table[-1][half:], out=above[: n - half])
        table.append(above)
    flat = np.concatenate(table) if len(table) > 1 else values
    base = levels * n
    return np.minimum(flat[base + first], flat[base + last - (1 << levels) + 1])


class _Scan:
    """One scan in ascending order of characters, over the text as it is or (down) with its characters turned over."""

    def __init__(self, text: np.ndarray, counts: np.ndarray, disk: Disk, down: bool) -> None:
        self._text, self._top, self._down, self._disk = text, len(counts) - 1, down, disk
        self._queue = Queue(counts[::-1] if down else counts, disk)
        #: Characters whose suffixes came in several waves, and in how many (see runs of one character).
        self.waves: dict[int, int] = {}
        # Characters that the bucket at hand has given tuples to, and the least common prefix since.
        self._given, self._since = np.empty(0, np.int64), np.empty(0, np.uint8)

    def left(self, places: np.ndarray) -> np.ndarray:
        """The character before each place, turned over in a descending scan; -1 at the start of the text."""
        out = self._text[np.maximum(places, 1) - 1].astype(np.int64)
        out = self._top - out if self._down else out
        out[places == 0] = -1
        return out

    def _induce(self, lefts: np.ndarray, places: np.ndarray, common: np.ndarray, into: np.ndarray, fresh: bool | None) -> tuple[np.ndarray, ...]:
        """Tuples of the left neighbours of those in into. fresh: the first place is the first of its character; None: so is the
        place that follows."""
        targets = lefts[into]
        if fresh is not False:
            self._given, self._since = np.empty(0, np.int64), np.empty(0, np.uint8)
        order = np.argsort(targets.astype(np.uint16) if self._top < 65_000 else targets, kind="stable")
        at, sorted_targets = into[order], targets[order]
        again = np.concatenate([[False], sorted_targets[1:] == sorted_targets[:-1]]) if len(at) else np.empty(0, bool)
        least = np.zeros(len(at), np.uint8)
        some = np.flatnonzero(again)
        if len(some):
            least[some] = _least(common, at[some - 1] + 1, at[some])
        firsts = np.flatnonzero(~again)
        if len(self._given) and len(firsts):
            spot = np.minimum(np.searchsorted(self._given, sorted_targets[firsts]), len(self._given) - 1)
            known = self._given[spot] == sorted_targets[firsts]
            if known.any():
                before = np.minimum.accumulate(common)
                least[firsts[known]] = np.minimum(self._since[spot[known]], before[at[firsts[known]]])
        out = np.empty(len(at), np.uint8)
        out[order] = np.minimum(least, MOST_COMMON - 1) + 1
        if fresh is None:
            return targets, places[into] - 1, out
        # What later parts of the same bucket need.
        ends = np.append(firsts[1:], len(at)) - 1 if len(firsts) else firsts
        after = np.concatenate([np.minimum.accumulate(common[::-1])[::-1], [np.uint8(MOST_COMMON)]])
        now, since = sorted_targets[firsts], after[at[ends] + 1] if len(firsts) else np.empty(0, np.uint8)
        if len(self._given):
            old = ~np.isin(self._given, now, assume_unique=True)
            now, since = np.concatenate([self._given[old], now]), np.concatenate([np.minimum(self._since[old], common.min()), since])
            order = np.argsort(now)
            now, since = now[order], since[order]
        self._given, self._since = now, since
        return targets, places[into] - 1, out

    def _bucket(self, c: int, waiting: Iterator[tuple[np.ndarray, ...]], seeds: Iterator[tuple[np.ndarray, ...]], run_of, late: list, until: int) -> Iterator[tuple]:
        """All of one character: what waits, wave by wave (a wave gives the next its suffixes that begin with one more of the
        character), then the seeds."""
        waves, fresh = 0, True
        wave = waiting
        while wave is not None:
            following, some = Run(self._disk), False
            for _, places, common in wave:
                common = common.copy()
                common[0] = 0 if fresh else common[0]
                lefts = self.left(places)
                yield places, common, np.full(len(places), c), lefts, True
                targets, new, told = self._induce(lefts, places, common, np.flatnonzero(lefts >= c), fresh)
                fresh, some = False, True
                same = targets == c
                following.add(targets[same], new[same], told[same])
                self._give(targets[~same], new[~same], told[~same], late, until)
            waves += some
            wave = following.taken() if following.size else None
            self._disk.runs.remove(following)
        first = True
        for _, places, common in seeds:
            common = common.copy()
            if first:
                common[0] = min(waves, run_of(np.array([c]), places[:1])[0], MOST_COMMON) if waves else 0
            lefts = self.left(places)
            yield places, common, np.full(len(places), c), lefts, False
            targets, new, told = self._induce(lefts, places, common, np.flatnonzero(lefts > c), fresh)
            fresh = first = False
            self._give(targets, new, told, late, until)
        if waves > 1:
            self.waves[c] = min(waves, MOST_COMMON)

    def _give(self, targets: np.ndarray, places: np.ndarray, common: np.ndarray, late: list, until: int) -> None:
        near = targets < until
        if near.any():
            late.append((targets[near], places[near], common[near]))
            far = ~near
            targets, places, common = targets[far], places[far], common[far]
        self._queue.push(targets, places, common)

    def run(self, seeds: _Seeds, run_of) -> Iterator[tuple]:
        """places, common prefixes with the place before, characters, characters to the left, and whether they come from the
        queue (one truth, or one for each). run_of(characters, places): how often a seed's first character stands there in a row."""
        kind = np.int32 if len(self._text) < 1 << 31 else np.int64
        none = (np.empty(0, np.int64), np.empty(0, kind), np.empty(0, np.uint8))
        edges = self._queue.edges.tolist()
        for i, (lo, hi) in enumerate(zip(edges[:-1], edges[1:], strict=True)):
            if hi == lo + 1:
                yield from self._bucket(lo, self._queue.taken(i), seeds.below(hi), run_of, [], hi)
                continue
            base = _joined(list(self._queue.taken(i)), none)
            order = np.argsort((base[0] - lo).astype(np.uint16) if hi - lo < 65_000 else base[0], kind="stable")
            base = tuple(a[order] for a in base)
            fixed = _joined(list(seeds.below(hi)), none)
            lefts = [self.left(base[1]), self.left(fixed[1])]
            # The least character, other than its own, at which any tuple from here on has its left neighbour.
            ahead = []
            for x, left in zip((base, fixed), lefts, strict=True):
                ahead.append(np.append(np.minimum.accumulate(np.where(left > x[0], left, hi)[::-1])[::-1], hi))
            late: list[tuple[np.ndarray, ...]] = []
            more, more_left = none, none[0]
            at = [0, 0]
            while True:
                if late:
                    fresh = _joined(late, none)
                    more, more_left, late = _joined([fresh], more), np.concatenate([more_left, self.left(fresh[1])]), []
                c = min([int(x[0][k]) for x, k in zip((base, fixed), at, strict=True) if k < len(x[0])] + ([int(more[0].min())] if len(more[0]) else []), default=hi)
                if c >= hi:
                    break
                end = min(int(ahead[0][at[0]]), int(ahead[1][at[1]]))
                if len(more[0]):
                    end = min(end, int(np.where(more_left > more[0], more_left, hi).min()))
                # No tuple of characters under end has its left neighbour among them, but for those of its own character.
                to = [int(np.searchsorted(x[0], end)) for x in (base, fixed)]
                mine = more[0] < end
                parts, left_parts = [tuple(a[at[0] : to[0]] for a in base)], [lefts[0][at[0] : to[0]]]
                if mine.any():
                    parts, left_parts = [_joined([tuple(a[mine] for a in more)], parts[0])], [np.concatenate([left_parts[0], more_left[mine]])]
                    order = np.argsort(parts[0][0], kind="stable")
                    parts, left_parts = [tuple(a[order] for a in parts[0])], [left_parts[0][order]]
                if len(parts[0][0]):
                    head = parts[0][2].copy()
                    head[np.concatenate([[True], parts[0][0][1:] != parts[0][0][:-1]])] = 0
                    parts[0] = (*parts[0][:2], head)
                # Waves: each gives the next its suffixes that begin with one more of the same character.
                while len(own := np.flatnonzero(left_parts[-1] == parts[-1][0])):
                    characters, places = parts[-1][0][own], parts[-1][1][own] - 1
                    told = np.full(len(own), min(len(parts), MOST_COMMON), np.uint8)
                    same = np.flatnonzero(characters[1:] == characters[:-1]) + 1
                    told[same] = np.minimum(_least(parts[-1][2], own[same - 1] + 1, own[same]), MOST_COMMON - 1) + 1
                    parts.append((characters, places, told))
                    left_parts.append(self.left(places))
                    end = min(end, int(np.where(left_parts[-1] > characters, left_parts[-1], hi).min()))
                if len(parts) > 1:
                    to = [int(np.searchsorted(x[0], end)) for x in (base, fixed)]
                    mine = more[0] < end
                    for k, (part, left) in enumerate(zip(parts, left_parts, strict=True)):
                        cut = int(np.searchsorted(part[0], end))
                        parts[k], left_parts[k] = tuple(a[:cut] for a in part), left[:cut]
                        if k and cut:
                            for x in np.unique(part[0][:cut]).tolist():
                                self.waves[x] = min(k + 1, MOST_COMMON)
                queue_size = sum(len(part[0]) for part in parts)
                parts.append(tuple(a[at[1] : to[1]] for a in fixed))
                left_parts.append(lefts[1][at[1] : to[1]])
                if len(more[0]):
                    more, more_left = tuple(a[~mine] for a in more), more_left[~mine]
                at = to
                if len(parts) == 2 and not len(parts[1][0]):
                    characters, places, common = parts[0]
                    left, queued = left_parts[0], True
                else:
                    characters, places, common = _joined(parts[1:], parts[0])
                    left = np.concatenate(left_parts)
                    queued = np.arange(len(places)) < queue_size
                    order = np.argsort(2 * characters - queued, kind="stable")
                    characters, places, common, left, queued = characters[order], places[order], common[order], left[order], queued[order]
                    met = np.flatnonzero(queued[:-1] & ~queued[1:] & (characters[1:] == characters[:-1])) + 1
                    common[np.flatnonzero(np.concatenate([[True], characters[1:] != characters[:-1]]))] = 0
                    common[met] = 1
                    deep = met[np.array([x in self.waves for x in characters[met].tolist()], bool)] if self.waves and len(met) else met[:0]
                    if len(deep):
                        most = np.array([self.waves[x] for x in characters[deep].tolist()])
                        common[deep] = np.minimum(np.minimum(most, run_of(characters[deep], places[deep])), MOST_COMMON)
                yield places, common, characters, left, queued
                targets, new, told = self._induce(left, places, common, np.flatnonzero(left > characters), None)
                self._give(targets, new, told, late, hi)
        self._queue.closed()


def _turns(text: np.ndarray, disk: Disk) -> np.ndarray:
    """Places of the turns, ascending; the closing 0 is the last."""
    run, end, rising = Run(disk), len(text) - 1, True
    while end > 0:
        start = max(0, end - 4 * SPAN)
        part = np.asarray(text[start : end + 1])
        change = np.flatnonzero(part[1:] != part[:-1])
        ends, kinds = np.append(change, len(part) - 2), np.append(part[change + 1] > part[change], rising)
        up = np.repeat(kinds, np.diff(ends, prepend=-1))
        before = np.asarray(text[max(start - 1, 0) : end - 1]) if start else np.concatenate([part[:1], part[:-2]])
        run.add((np.flatnonzero(up & (before > part[:-1])) + start).astype(np.int64))
        rising, end = bool(up[0]), start
    out = disk.room(run.size + 1, np.int32 if len(text) < 1 << 31 else np.int64)
    at = len(out) - 1
    out[at] = len(text) - 1
    for (places,) in run.taken(backwards=False):
        # Chunks come from the end of the text, and parts in a chunk, too.
        places = np.sort(places)
        out[at - len(places) : at] = places
        at -= len(places)
    run.closed()
    return out


def _equal(text: np.ndarray, a: int, b: int, n: int) -> bool:
    return all(np.array_equal(text[a + k : a + min(k + SPAN, n)], text[b + k : b + min(k + SPAN, n)]) for k in range(0, n, SPAN))


def _names(text: np.ndarray, counts: np.ndarray, starts: np.ndarray, disk: Disk) -> tuple[np.ndarray, int]:
    """Names of the stretches by their order, in the order of their places (0 for the last), and how many there are."""
    order = Queue(counts, disk)
    for k in range(0, len(starts), SPAN):
        places = np.asarray(starts[k : k + SPAN])
        order.push(text[places].astype(np.int64), places, np.ones(len(places), np.uint8))

    def by_character() -> Iterator[tuple[np.ndarray, ...]]:
        for i in range(len(order.edges) - 1):
            one = order.edges[i + 1] == order.edges[i] + 1
            for chunk in order.taken(i) if one else [_joined(list(order.taken(i)), (np.empty(0, np.int64), np.empty(0, starts.dtype), np.empty(0, np.uint8)))]:
                by = np.argsort(chunk[0], kind="stable")
                yield tuple(a[by] for a in chunk)

    once = lambda characters, places: np.ones(len(places), np.int64)
    names, number, last, since = disk.room(len(starts), np.int32 if len(starts) < 1 << 30 else np.int64), 0, None, MOST_COMMON
    for places, common, characters, left, queued in _both_scans(text, counts, _Seeds(by_character()), once, disk):
        at = np.flatnonzero(queued & (left >= 0) & (left < characters))  # turned over: the character to the left is greater
        if not len(at):
            since = min(since, int(common.min(initial=MOST_COMMON)))
            continue
        least = np.minimum.reduceat(common[: at[-1] + 1], np.concatenate([[0], at[:-1] + 1]))
        least[0] = min(int(least[0]), since)
        since = int(common[at[-1] + 1 :].min(initial=MOST_COMMON))
        found = np.searchsorted(starts, places[at])
        sizes = np.asarray(starts[found + 1]) - places[at] + 1
        before = np.concatenate([[-1 if last is None else last[1]], sizes[:-1]])
        same = (sizes == before) & (least >= np.minimum(sizes, MOST_COMMON))
        for k in np.flatnonzero(same & (sizes > MOST_COMMON)).tolist():
            same[k] = _equal(text, int(places[at[k]]), int(places[at[k - 1]]) if k else last[0], int(sizes[k]))
        told = number + np.cumsum(~same)
        names[found] = told
        number, last = int(told[-1]), (int(places[at[-1]]), int(sizes[-1]))
    order.closed()
    for k in range(0, len(names) - 1, SPAN):
        part = slice(k, min(k + SPAN, len(names) - 1))
        names[part] = number + 1 - names[part]
    names[len(names) - 1] = 0
    return names, number


def _both_scans(text: np.ndarray, counts: np.ndarray, seeds: _Seeds, run_of, disk: Disk) -> Iterator[tuple]:
    """From the turns in order, all suffixes but the last in descending order: places, common prefixes with the place before,
    characters turned over, characters to the left turned over, whether a suffix is a rising one."""
    up, falling = _Scan(text, counts, disk, False), Run(disk)
    for places, common, characters, _, queued in up.run(seeds, run_of):
        if queued is True:
            falling.add(characters.astype(np.int64), places, common)
        elif queued is not False:
            falling.add(characters[queued].astype(np.int64), places[queued], common[queued])
    top = len(counts) - 1

    def descending() -> Iterator[tuple[np.ndarray, ...]]:
        after = np.uint8(0)
        for characters, places, common in falling.taken(backwards=True):
            yield top - characters[::-1], places[::-1], np.append(common[1:], after)[::-1]
            after = common[0]

    waves = up.waves
    in_a_row = lambda characters, places: np.array([waves.get(top - int(c), 1) for c in characters])
    for places, common, characters, left, queued in _Scan(text, counts, disk, True).run(_Seeds(descending()), in_a_row):
        yield places, common, characters, left, np.broadcast_to(queued, len(places))
    falling.closed()


def _in_a_row(text: np.ndarray, places: np.ndarray) -> np.ndarray:
    out = np.ones(len(places), np.int64)
    for k, p in enumerate(places.tolist()):
        part = text[p : p + MOST_COMMON + 1]
        differ = np.flatnonzero(part != part[0])
        out[k] = differ[0] if len(differ) else len(part)
    return out


def _common(text: np.ndarray, starts: np.ndarray, a: np.ndarray, b: np.ndarray, names: np.ndarray) -> np.ndarray:
    """Common prefixes of the suffixes at turns a and b (numbers) that have so many names in common."""
    out = np.minimum(starts[np.minimum(b + names.astype(np.int64), len(starts) - 1)] - starts[b], MOST_COMMON).astype(np.int64)
    out[names == MOST_COMMON] = MOST_COMMON
    x, y = np.asarray(starts[a]).astype(np.int64), np.asarray(starts[b]).astype(np.int64)
    open_ = np.flatnonzero(out < MOST_COMMON)
    while len(open_):
        open_ = open_[text[x[open_] + out[open_]] == text[y[open_] + out[open_]]]
        out[open_] += 1
        open_ = open_[out[open_] < MOST_COMMON]
    return out.astype(np.uint8)


def _within_memory(text: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """As descending_suffixes(), for names that are few enough: by ranks of doubled length."""
    n, rank, kept, k = len(text), np.asarray(text).astype(np.int64), [], 1
    while True:
        if k < MOST_COMMON:
            kept.append(rank.astype(np.int32))
        after = np.zeros(n, np.int64)
        after[: n - k] = rank[k:] + 1
        key = rank * (int(rank.max()) + 2) + after
        order = np.argsort(key, kind="stable")
        rank = np.empty(n, np.int64)
        rank[order] = np.concatenate([[0], np.cumsum(np.diff(key[order]) != 0)])
        k *= 2
        if rank[order[-1]] == n - 1:
            break
    order = order[:0:-1]
    common = np.zeros(n - 1, np.int64)
    for j in reversed(range(len(kept))):
        # Ranks of 2**j names tell whether so many more are the same; the closing 0 keeps places apart before the end.
        a, b = order[:-1] + common[1:], order[1:] + common[1:]
        same = (a < n) & (b < n)
        same[same] = kept[j][a[same]] == kept[j][b[same]]
        common[1:][same] += 1 << j
    yield order, np.minimum(common, MOST_COMMON).astype(np.uint8)


def descending_suffixes(text: np.ndarray, characters: int, disk: Disk | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(places, common prefixes) of all suffixes but the last, in descending order; a common prefix is that with the suffix
    before it in this order, up to MOST_COMMON. text: whole numbers under characters, 0 at the end alone."""
    disk = Disk() if disk is None else disk
    disk.depth += 1
    counts = np.zeros(characters, np.int64)
    for k in range(0, len(text), SPAN):
        counts += np.bincount(text[k : k + SPAN], minlength=characters)
    starts = _turns(text, disk)
    order = Run(disk)  # numbers of turns, descending, and common prefixes with the one before
    if len(starts) == 2:
        order.add(np.zeros(1, np.int64), np.zeros(1, np.uint8))
    elif len(starts) > 2:
        names, kinds = _names(text, counts, starts, disk)
        last = None
        if kinds == len(starts) - 1:
            by_name = disk.room(len(names), names.dtype)
            for k in range(0, len(names), SPAN):
                by_name[names[k : k + SPAN]] = np.arange(k, min(k + SPAN, len(names)))
            # Chunks of places in descending order; no two suffixes have their first name in common.
            below = ((np.asarray(by_name[max(k - SPAN, 1) : k])[::-1], np.zeros(k - max(k - SPAN, 1), np.uint8)) for k in range(len(by_name), 1, -SPAN))
        elif len(names) * NAME_BYTES <= disk.most:
            below = _within_memory(names)
        else:
            below = descending_suffixes(names, kinds + 1, disk)
        for numbers, common in below:
            numbers = numbers.astype(np.int64)
            before = np.concatenate([numbers[:1] if last is None else [last], numbers[:-1]])
            told = np.zeros(len(numbers), np.uint8)
            real = np.flatnonzero(before != numbers)
            told[real] = _common(text, starts, before[real], numbers[real], common[real])
            order.add(numbers, told)
            last = int(numbers[-1])

    def ascending() -> Iterator[tuple[np.ndarray, ...]]:
        yield np.zeros(1, np.int64), np.asarray(starts[-1:]), np.zeros(1, np.uint8)
        after = np.uint8(0)
        for numbers, common in order.taken(backwards=True):
            places = np.asarray(starts[numbers[::-1]])
            yield text[places].astype(np.int64), places, np.append(common[1:], after)[::-1]
            after = common[0]

    for places, common, *_ in _both_scans(text, counts, _Seeds(ascending()), lambda _, places: _in_a_row(text, places), disk):
        yield places, common
    order.closed()
