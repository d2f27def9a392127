"""Scalar helpers: trimming, hashing, ordered rewrites, natural sort keys."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Unicode classes and only \\n as a line end, as the patterns of the catalogue expect.
FLAGS = "(?Ud)"
#: All that the pattern (?U)\\s matches.
WHITE = "\t\n\x0b\f\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


def strip(c: Column) -> Column:
    """Without white space (of any kind) at both ends; Spark's trim() takes off spaces only. Looks at both ends alone, unlike a pattern."""
    return F.btrim(c, F.lit(WHITE))


def stable_hash(c: Column, modulus: int) -> Column:
    """The first 32 bits of the MD5, modulo modulus: the same in each run and in other engines."""
    return F.conv(F.substring(F.md5(c.cast("binary")), 1, 8), 16, 10).cast("long") % modulus


def rewrite(c: Column, rules: Iterable[tuple[str, str]]) -> Column:
    """Each (pattern, replacement) in turn, stripping after each."""
    for pattern, replacement in rules:
        c = strip(F.regexp_replace(c, pattern if pattern.startswith("(?") and "U" in pattern[:6] else FLAGS + pattern, replacement))
    return c


def any_match(c: Column, patterns: Iterable[str]) -> Column:
    """Whether any pattern is found in c."""
    out = F.lit(False)
    for p in patterns:
        out = out | F.coalesce(c.rlike(p), F.lit(False))
    return out


def natural_key(c: Column, width: int = 20) -> Column:
    """A string that sorts c with its numbers by value."""
    parts = F.regexp_extract_all(c, F.lit(r"\d+|\D+"), F.lit(0))
    return F.array_join(F.transform(parts, lambda p: F.when(p.rlike(r"^\d"), F.lpad(p, width, "0")).otherwise(p)), "")


def case_words(c: Column) -> Column:
    """A token split where case changes: 'parseHTTPHeader' to parse, HTTP, Header."""
    return F.split(c, r"(?<!^)(?<![A-Z])(?=[A-Z])|(?<!^)(?=[A-Z][a-z])")


def bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value computed once even where body uses it in a lambda."""
    return F.get(F.transform(F.array(value), body), F.lit(0))
