"""Repair of conversation structure: the cheapest edits that make the turns of a conversation follow (system)? (user assistant)+.

Each turn is a 4 x 4 matrix over (cost, audit): its entry (i, j) is the cheapest way from state i to state j (nothing yet, system,
user, assistant) by one edit of the turn and any insertions after it. Products take the least sum of costs, then the least audit
in ASCII order; as cost follows from the letters of an audit, audits of equal cost are never prefixes of each other, so the
product is associative and turns may be multiplied in any grouping. Turns are dealt by ranges of (conversation, turn), so a very
long conversation lies in many tasks; each multiplies its run of turns as a balanced tree, and the runs of conversations that
cross tasks are multiplied FAN by FAN in rounds. Counts of faults travel with the matrices.

Edits: Keep costs 0, Rerole (to user or assistant) 3, Delete 4, Insert (an empty user or assistant turn) 3; blank and duplicate
turns must be deleted, and a truncated turn that stays costs 3 more. Of a turn's faults the first counts: blank (no character but
white space), duplicate (role and text stood earlier in the conversation), truncated (the last such character is no . ! or ?).

Order: by turn, nulls first; turns of equal number by role and then by the text's hash. Null roles and texts count as one space;
roles with initials other than s, u and a can't be kept. A null conversation id is a conversation of its own. Repeated rows are
duplicates. Rows marked as gone only keep their conversation in the result: without other rows it has zeros and an empty audit.
An empty table gives an empty table. Columns of other names don't pass through.

replayed() sends each conversation's rows in order through one task, row by row and without holding them; that is as much as a
hash of the whole repaired text needs.
"""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberlog.llm.memory import small_batches, tidy
from emberlog.llm.scratch import dropped, saved

#: Runs of a conversation that are multiplied in one group of a round.
FAN = 64
REROLE, DELETE, INSERT, CUT_OFF = 3, 4, 3, 3
START, SYSTEM, USER, ASSISTANT = range(4)
#: The state that a user or assistant turn comes from, and what a turn of each initial leads to.
_NEXT = {START: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}
_KEEPS = {"s": {START: SYSTEM}, "u": {START: USER, SYSTEM: USER, ASSISTANT: USER}, "a": {USER: ASSISTANT}}
_ROLES = {USER: "user", ASSISTANT: "assistant"}
_LEGAL = {"su", "ua", "au"}

#: An entry of a matrix; None where there is no way.
Element = tuple[int, str] | None
Matrix = tuple[Element, ...]


def times(a: Matrix, b: Matrix) -> Matrix:
    """The min-plus product."""
    out: list[Element] = []
    for i in range(4):
        row = [(k, x) for k, x in enumerate(a[4 * i : 4 * i + 4]) if x is not None]
        for j in range(4):
            ways = [(x[0] + y[0], x[1], y[1]) for k, x in row if (y := b[4 * k + j]) is not None]
            if not ways:
                out.append(None)
                continue
            least = min(w[0] for w in ways)
            out.append((least, min(p + q for c, p, q in ways if c == least)))
    return tuple(out)


def _closure() -> Matrix:
    """No insertion, or the cheapest ones between two states."""
    one: list[Element] = [(0, "") if i == j else None for i in range(4) for j in range(4)]
    for i, j in _NEXT.items():
        one[4 * i + j] = (INSERT, "I")
    return times(tuple(one), tuple(one))


IDENTITY: Matrix = tuple((0, "") if i == j else None for i in range(4) for j in range(4))
CLOSURE = _closure()


def turn_matrix(initial: str, fault: str) -> Matrix:
    """One turn by its role's initial and its fault: b, d, t or none."""
    edit: list[Element] = [(DELETE, "D") if i == j else None for i in range(4) for j in range(4)]
    if fault not in ("b", "d"):
        more = CUT_OFF if fault == "t" else 0
        for i, j in _NEXT.items():
            edit[4 * i + j] = (REROLE + more, "R")
        for i, j in _KEEPS.get(initial, {}).items():
            edit[4 * i + j] = (more, "K")
    return times(tuple(edit), CLOSURE)


_TURNS = {(i, f): turn_matrix(i, f) for i in "sua?" for f in ("", "b", "d", "t")}


class _Tree:
    """A product of matrices in order, as a balanced tree: a stack of products of falling numbers of turns."""

    def __init__(self) -> None:
        self._stack: list[tuple[int, Matrix]] = []

    def add(self, m: Matrix) -> None:
        size = 1
        while self._stack and self._stack[-1][0] == size:
            _, before = self._stack.pop()
            m, size = times(before, m), 2 * size
        self._stack.append((size, m))

    def product(self) -> Matrix:
        out = None
        for _, m in reversed(self._stack):
            out = m if out is None else times(m, out)
        return IDENTITY if out is None else out


class Run:
    """What is known of adjacent turns of one conversation; runs merge in order."""

    FIELDS = "turns long, blank long, duplicate long, truncated long, illegal long, distinct long, least long, most long, first_turn long, last_turn long, first_initial string, last_initial string, costs array<long>, audits array<string>"
    __slots__ = ("blank", "distinct", "duplicate", "first_initial", "first_turn", "illegal", "last_initial", "last_turn", "least", "matrix", "most", "truncated", "turns")

    def __init__(self) -> None:
        self.turns = self.blank = self.duplicate = self.truncated = self.illegal = self.distinct = 0
        self.least = self.most = self.first_turn = self.last_turn = None
        self.first_initial = self.last_initial = None
        self.matrix = IDENTITY

    def then(self, other: Run) -> Run:
        """This run and the one after it, as one."""
        if not self.turns or not other.turns:
            return self if self.turns else other
        out = Run()
        for name in ("turns", "blank", "duplicate", "truncated"):
            setattr(out, name, getattr(self, name) + getattr(other, name))
        out.illegal = self.illegal + other.illegal + (self.last_initial + other.first_initial not in _LEGAL)
        out.distinct = self.distinct + other.distinct - (self.last_turn is not None and self.last_turn == other.first_turn)
        # Nulls come first: only the other's can be all that is known.
        out.least = other.least if self.least is None else self.least
        out.most = self.most if other.most is None else other.most
        out.first_turn, out.last_turn = self.first_turn, other.last_turn
        out.first_initial, out.last_initial = self.first_initial, other.last_initial
        out.matrix = times(self.matrix, other.matrix)
        return out

    def values(self) -> list:
        costs, audits = [None if e is None else e[0] for e in self.matrix], [None if e is None else e[1] for e in self.matrix]
        return [self.turns, self.blank, self.duplicate, self.truncated, self.illegal, self.distinct, self.least, self.most, self.first_turn, self.last_turn, self.first_initial, self.last_initial, costs, audits]

    @classmethod
    def of(cls, values: list) -> Run:
        out = cls()
        out.turns, out.blank, out.duplicate, out.truncated, out.illegal, out.distinct, out.least, out.most, out.first_turn, out.last_turn, out.first_initial, out.last_initial = values[:12]
        out.matrix = tuple(None if c is None else (c, a) for c, a in zip(values[12], values[13], strict=True))
        return out

    def best(self) -> tuple[int, str]:
        """The cheapest edits of a whole conversation."""
        whole = times(CLOSURE, self.matrix)
        return min(e for e in (whole[START], whole[ASSISTANT]) if e is not None)


def _run_of(turns: Iterable[tuple]) -> Run:
    """turns: (gone, turn, role, hash, blank, stood before, cut off) in order."""
    out, tree, before = Run(), _Tree(), None
    for gone, turn, role, digest, blank, stood, cut in turns:
        if gone:
            continue
        initial = role[:1]
        fault = "b" if blank else "d" if stood or before == (turn, role, digest) else "t" if cut else ""
        tree.add(_TURNS[initial if initial in _KEEPS else "?", fault])
        out.blank += fault == "b"
        out.duplicate += fault == "d"
        out.truncated += fault == "t"
        if out.turns:
            out.illegal += out.last_initial + initial not in _LEGAL
        else:
            out.first_turn, out.first_initial = turn, initial
        if turn is not None and (not out.turns or turn != out.last_turn):
            out.distinct += 1
            out.least, out.most = turn if out.least is None else out.least, turn
        out.turns += 1
        out.last_turn, out.last_initial = turn, initial
        before = turn, role, digest
    out.matrix = tree.product()
    return out


def _rows(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(c.to_pylist() for c in batch.columns), strict=True)


def _runs(kind: pa.DataType) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Ordered turns of a task to a run for each conversation; those that may go on in other tasks are edges."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, held, first = TaskContext.get().partitionId(), [], True
        for conv, turns in itertools.groupby(_rows(batches), key=lambda r: r[0]):
            if len(held) >= 1000:
                yield _table(held[:-1], kind)
                held = held[-1:]
            held.append([conv, task, first, *_run_of(t[1:] for t in turns).values()])
            first = False
        if held:
            held[-1][2] = True
            yield _table(held, kind)

    return tidy(run)


def _table(rows: list[list], kind: pa.DataType) -> pa.RecordBatch:
    types = [kind, pa.int64(), pa.bool_(), *[pa.int64()] * 10, pa.string(), pa.string(), pa.list_(pa.int64()), pa.list_(pa.string())]
    names = ["conv", "part", "edge", *(f.split()[0] for f in Run.FIELDS.split(", "))]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)


def _merged(table: pa.Table) -> pa.Table:
    """The runs of one group, as one."""
    table = table.sort_by("part")
    rows = list(_rows(table.to_batches()))
    whole = Run()
    for r in rows:
        whole = whole.then(Run.of(list(r[3:])))
    return pa.Table.from_batches([_table([[rows[0][0], rows[0][1] // FAN, True, *whole.values()]], table.schema.field("conv").type)])


def _judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = []
        for r in _rows([batch]):
            run = Run.of(list(r[3:]))
            cost, audit = run.best()
            gaps = 0 if run.least is None else run.most - run.least + 1 - run.distinct
            found.append((r[0], gaps, run.blank, run.duplicate, run.truncated, run.illegal, cost, audit))
        types = [batch.schema.field(0).type, *[pa.int64()] * 6, pa.string()]
        columns = zip(*found, strict=True) if found else [[]] * 8
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], ["conv", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit"])


def _prepared(turns: DataFrame, conv: str, turn: str, role: str, text: str, gone: str | None) -> DataFrame:
    """conv, gone, turn, role, hash and text, with nulls of role and text as one space."""
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    mark: Column = F.coalesce(F.col(gone), F.lit(False)) if gone else F.lit(False)
    return turns.select(F.col(conv).alias("conv"), mark.alias("gone"), F.col(turn).cast("long").alias("turn"), space(role).alias("role"), F.sha2(space(text), 256).alias("hash"), space(text).alias("text"))


def audits(turns: DataFrame, *, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", gone: str | None = None) -> DataFrame:
    """For each conversation gaps, blank, duplicate, truncated, illegal, cost (all long) and audit."""
    small_batches(turns.sparkSession)
    rows = _prepared(turns, conv, turn, role, text, gone)
    bare = F.regexp_replace("text", "[\\x20\\x09-\\x0D]+$", "")
    narrow = rows.select("conv", "gone", "turn", "role", "hash", (bare == "").alias("blank"), (~F.right(bare, F.lit(1)).isin(".", "!", "?")).alias("cut"))
    first = narrow.filter(~F.col("gone")).groupBy(F.col("conv").alias("c"), F.col("role").alias("r"), F.col("hash").alias("h")).agg(F.min(F.struct(F.col("turn").isNotNull(), F.col("turn").alias("turn")))["turn"].alias("first"))
    met = narrow.join(first, F.col("conv").eqNullSafe(F.col("c")) & (F.col("role") == F.col("r")) & (F.col("hash") == F.col("h")), "left")
    stood = F.when(F.col("first").isNull(), F.col("turn").isNotNull()).otherwise(F.col("turn") > F.col("first"))
    # Ranges are dealt by a sample, which reads the rows once more.
    marked = saved(met.select("conv", "gone", "turn", "role", "hash", "blank", F.coalesce(stood, F.lit(False)).alias("stood"), "cut"))
    order = ["conv", "turn", "role", "hash"]
    kind = dict(marked.dtypes)["conv"]
    schema = f"conv {kind}, part long, edge boolean, {Run.FIELDS}"
    runs = saved(marked.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(_runs_of(kind), schema))
    dropped(marked)
    edges = runs.filter("edge")
    while (edges.groupBy("conv").count().agg(F.max("count")).first()[0] or 0) > 1:
        edges = saved(edges.groupBy("conv", F.floor(F.col("part") / FAN)).applyInArrow(_merged, schema))
    return runs.filter("NOT edge").unionByName(edges).mapInArrow(_judged, f"conv {kind}, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string").withColumnRenamed("conv", conv)


def _runs_of(kind: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    return _runs({"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}[kind])


def replay(rows: Iterable[tuple]) -> Iterator[tuple]:
    """rows: (conv, audit, None, None) and then that conversation's (conv, None, role, text) in order, to (conv, edit, role, text) of
    all turns that stand after the edits, and (conv, None, None, None) at each conversation's end."""
    for conv, own in itertools.groupby(rows, key=lambda r: r[0]):
        letters, state = iter(next(own)[1]), START
        for letter in letters:
            if letter == "I":
                state = _NEXT[state]
                yield conv, "I", _ROLES[state], ""
                continue
            _, _, role, text = next(own)
            if letter == "K":
                state = _KEEPS[role[:1]][state]
                yield conv, "K", role, text
            elif letter == "R":
                state = _NEXT[state]
                yield conv, "R", _ROLES[state], text
        yield conv, None, None, None


def _ordered(turns: DataFrame, found: DataFrame, conv: str, turn: str, role: str, text: str, gone: str | None) -> DataFrame:
    """Each conversation's audit and then its turns, in one task and in order."""
    rows = _prepared(turns, conv, turn, role, text, gone).filter(~F.col("gone"))
    none = F.lit(None)
    first = found.select(F.col(conv).alias("conv"), F.lit(0).alias("kind"), none.cast("long").alias("turn"), none.cast("string").alias("role"), none.cast("string").alias("hash"), none.cast("string").alias("text"), "audit")
    rest = rows.select("conv", F.lit(1).alias("kind"), "turn", "role", "hash", "text", none.cast("string").alias("audit"))
    every = first.unionByName(rest).repartition("conv").sortWithinPartitions("conv", "kind", "turn", "role", "hash")
    return every.select("conv", "audit", "role", "text")


def replayed(turns: DataFrame, found: DataFrame, *, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", gone: str | None = None) -> DataFrame:
    """The repaired turns: conversation, place (from 0), edit (K, R or I), role and text. found: audits() of the same turns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, held, size, kind = 0, [], 0, None

        def kept() -> Iterator[pa.RecordBatch]:
            nonlocal kind
            for b in batches:
                kind = b.schema.field(0).type
                yield b

        def batch() -> pa.RecordBatch:
            types = [kind, pa.int64(), pa.string(), pa.string(), pa.string()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), types, strict=True)], ["conv", "place", "edit", "role", "text"])

        for one, edit, who, said in replay(_rows(kept())):
            if edit is None:
                place = 0
                continue
            held.append((one, place, edit, who, said))
            place, size = place + 1, size + len(said)
            if len(held) >= 1000 or size >= 4 << 20:
                yield batch()
                held, size = [], 0
        if held:
            yield batch()

    rows = _ordered(turns, found, conv, turn, role, text, gone)
    return rows.mapInArrow(tidy(run), f"conv {dict(rows.dtypes)['conv']}, place long, edit string, role string, text string").withColumnRenamed("conv", conv)


def digests(turns: DataFrame, found: DataFrame, *, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", gone: str | None = None) -> DataFrame:
    """found (audits() of the same turns) with repaired_sha256: lowercase hex of the repaired role:text, joined by newlines."""
    seen = saved(found)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind, held, at, count = None, [], hashlib.sha256(), 0

        def kept() -> Iterator[pa.RecordBatch]:
            nonlocal kind
            for b in batches:
                kind = b.schema.field(0).type
                yield b

        def batch() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([c for c, _ in held], kind), pa.array([d for _, d in held])], ["conv", "repaired_sha256"])

        for one, edit, who, said in replay(_rows(kept())):
            if edit is not None:
                at.update(("\n" * bool(count) + who + ":" + said).encode())
                count += 1
                continue
            held.append((one, at.hexdigest()))
            at, count = hashlib.sha256(), 0
            if len(held) >= 5000:
                yield batch()
                held = []
        if held:
            yield batch()

    rows = _ordered(turns, seen, conv, turn, role, text, gone)
    hashed = rows.mapInArrow(tidy(run), f"conv {dict(rows.dtypes)['conv']}, repaired_sha256 string")
    return seen.join(hashed, F.col(conv).eqNullSafe(F.col("conv"))).drop("conv")
