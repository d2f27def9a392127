"""Column helpers that keep work in the JVM: bindings, prefix sums and match positions inside one row."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

_BLOCK = 128


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once; a column used inside a lambda would else be computed for each element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def running_starts(lengths: Column) -> Column:
    """Of array<int> lengths, the sum of all before each element. Blocks keep it near linear for long arrays."""

    def total(part: Column) -> Column:
        return F.aggregate(part, F.lit(0), lambda a, x: a + x)

    def of(xs: Column) -> Column:
        blocks = F.ceil(F.size(xs) / F.lit(_BLOCK)).cast("int")
        sums = F.transform(F.sequence(F.lit(0), blocks - 1), lambda b: total(F.slice(xs, b * _BLOCK + 1, F.lit(_BLOCK))))
        before = let(sums, lambda s: F.transform(s, lambda _, b: total(F.slice(s, F.lit(1), b))))
        here = lambda i: (i / F.lit(_BLOCK)).cast("int")
        return let(before, lambda p: F.transform(xs, lambda _, i: F.get(p, here(i)) + total(F.slice(xs, here(i) * _BLOCK + 1, i % _BLOCK))))

    return let(lengths, lambda xs: F.when(F.size(xs) > 0, of(xs)).otherwise(F.array().cast("array<int>")))


def words_of(text: Column) -> Column:
    """Runs of anything but the six spaces; none for null."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), "[\\x20\\x09-\\x0D]+"), "")


def char_count(text: Column, pattern: str) -> Column:
    """How many code points of text match pattern, which matches one at a time."""
    return F.length(text) - F.length(F.regexp_replace(text, pattern, ""))


def swept(items: Column, start: Column, step: Callable[[Column, Column], Column], state: str, element: str) -> tuple[Column, Column]:
    """A fold over items that gives out elements on its way: the last state, and all elements in order.

    step(state, item) is a struct of the next state (st) and an array of elements to give out (out). Elements are gathered in
    blocks, so that time is near linear for long arrays.
    """
    inner, outer = f"struct<st: {state}, out: array<{element}>>", f"struct<st: {state}, out: array<array<{element}>>>"

    def fold(block: Column, st: Column) -> Column:
        def one(a: Column, x: Column) -> Column:
            return let(step(a["st"], x), lambda n: F.struct(n["st"].alias("st"), F.when(F.size(n["out"]) > 0, F.concat(a["out"], n["out"])).otherwise(a["out"]).alias("out")).cast(inner))

        return F.aggregate(block, F.struct(st.alias("st"), F.array().cast(f"array<{element}>").alias("out")).cast(inner), one)

    def of(xs: Column) -> Column:
        size = 4 * _BLOCK
        numbers = F.sequence(F.lit(0), F.greatest(F.ceil(F.size(xs) / F.lit(size)).cast("int"), F.lit(1)) - 1)
        blocks = F.transform(numbers, lambda b: F.slice(xs, b * size + 1, F.lit(size)))
        first = F.struct(start.alias("st"), F.array().cast(f"array<array<{element}>>").alias("out")).cast(outer)
        return F.aggregate(blocks, first, lambda a, block: let(fold(block, a["st"]), lambda n: F.struct(n["st"].alias("st"), F.when(F.size(n["out"]) > 0, F.array_append(a["out"], n["out"])).otherwise(a["out"]).alias("out")).cast(outer)))

    done = let(items, of)
    return done["st"], F.flatten(done["out"])


def pieces_of(text: Column, bounds: Column) -> Column:
    """text between bounds: array<struct<start, end>> (code points) to array<string>; linear, as each piece is found from the
    blocks that hold it and not from the start of the text."""
    size = 2048
    blocks = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{size}}}"), F.lit(0))

    def piece(bs: Column, s: Column) -> Column:
        a, z = (s["start"] / F.lit(size)).cast("int"), (s["end"] / F.lit(size)).cast("int")
        at = lambda b: F.coalesce(F.get(bs, b), F.lit(""))
        here = F.substr(at(a), s["start"] % size + 1, s["end"] - s["start"])
        across = F.concat(F.substr(at(a), s["start"] % size + 1), F.array_join(F.slice(bs, a + 2, F.greatest(z - a - 1, F.lit(0))), ""), F.substr(at(z), F.lit(1), s["end"] % size))
        return F.when(a == z, here).otherwise(across)

    return let(blocks, lambda bs: F.transform(bounds, lambda s: piece(bs, s)))
