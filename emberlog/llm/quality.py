"""Quality rules as a short-circuit cascade.

Each rule is a SQL condition that rejects a text. A bounded random sample tells how long each rule takes, as the very
expression that is run later, and how much it rejects; the rules then run in the order of rejections per second, and a text
that one rule rejects meets no later rule. The order changes the work only: a text is kept if no rule rejects it, whatever
the order.

Null text counts as empty, an empty text fails the word-count rule, repeated rows are judged each for itself, an empty table
gives an empty table, and computed columns replace input columns of the same name.
"""

from __future__ import annotations

import time
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberlog.llm.native import char_count, let, words_of

#: Symbols, letters and digits that are counted, and line beginnings and ends of lists and cut-off teasers.
SYMBOLS, UPPER, DIGITS, BRACES = "[#*$%&|<>]", "[A-Z]", "[0-9]", "[{}]"
BULLET, ELLIPSIS, BROKEN = "^[\\x20\\x09]*[-*\u2022\u2023\u25aa\u25e6]", "(?:\\.\\.\\.|\u2026)[\\x20\\x09\\x0D]*$", "\ufffd"
#: A rule's share of the sample and its time are taken from so many rows at most.
SAMPLE_ROWS = 256
#: Larger texts aren't taken into the sample, which so holds 16 MB at most; they are judged like all others.
SAMPLE_TEXT_BYTES = 64 << 10


@dataclass(frozen=True)
class Rule:
    """reject: true for a text that goes; it may read the text only."""

    name: str
    reject: Column


def word_chars(text: Column) -> Column:
    return F.length(F.array_join(words_of(text), ""))


def n_symbols(text: Column) -> Column:
    return char_count(F.coalesce(text, F.lit("")), SYMBOLS)


def filled_lines(text: Column) -> Column:
    """Lines that have a word."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), "\n"), lambda line: line.rlike("[^\\x20\\x09-\\x0D]"))


def n_dup_lines(lines: Column) -> Column:
    return let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x)))


def n_repeat_words(words: Column) -> Column:
    """Words inside a 3-word window that the text holds twice or more, the first included.

    Windows are compared by 64-bit hash inside one text. Only texts with a repeated hash sort their windows.
    """

    def covered(grams: Column) -> Column:
        pairs = F.sort_array(F.transform(grams, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        twice = let(pairs, lambda s: F.filter(s, lambda x, i: (F.get(s, i - 1)["h"] == x["h"]) | (F.get(s, i + 1)["h"] == x["h"])))
        places = F.sort_array(F.transform(twice, lambda x: x["i"]))
        steps = let(places, lambda p: F.transform(p, lambda v, i: F.least(F.lit(3), F.coalesce(F.get(p, i + 1) - v, F.lit(3)))))
        return F.aggregate(steps, F.lit(0), lambda a, x: a + x)

    def count(w: Column) -> Column:
        grams = F.transform(F.slice(w, F.lit(1), F.greatest(F.size(w) - 2, F.lit(0))), lambda x, i: F.xxhash64(x, F.get(w, i + 1), F.get(w, i + 2)))
        return let(grams, lambda g: F.when(F.size(F.array_distinct(g)) == F.size(g), F.lit(0)).otherwise(covered(g)))

    return let(words, count)


def base_rules(text: Column, words: Column | None = None) -> list[Rule]:
    """Too short, or half of the words inside repeated windows. words: of the text, where they are split anyway."""
    words = words_of(text) if words is None else words
    return [
        Rule("few_words", F.size(words) < 50),
        Rule("repeats", let(words, lambda w: 100 * n_repeat_words(w) > 50 * F.size(w))),
    ]


def method_rules(text: Column, known: dict[str, Column] | None = None) -> list[Rule]:
    """Symbols on many words, mostly capitals, mostly digits, many equal lines, word lengths that no prose has, lists and cut-off
    teasers instead of paragraphs, program code, and characters lost on the way.

    known: columns of n_words, word_chars, n_symbols, n_dup_lines and n_lines, where they are counted anyway.
    """
    t = F.coalesce(text, F.lit(""))
    known = known or {}
    n_words, chars = known.get("n_words", F.size(words_of(t))), known.get("word_chars", word_chars(t))
    matching = lambda lines, pattern: F.size(F.filter(lines, lambda x: x.rlike(pattern)))
    if "n_dup_lines" in known:
        equal = (known["n_dup_lines"] > 0) & (100 * known["n_dup_lines"] > 50 * known["n_lines"])
    else:
        equal = let(filled_lines(t), lambda x: 100 * n_dup_lines(x) > 50 * F.size(x))
    return [
        Rule("symbols", 10 * known.get("n_symbols", n_symbols(t)) > n_words),
        Rule("capitals", 2 * char_count(t, UPPER) > chars),
        Rule("digits", 10 * char_count(t, DIGITS) > 7 * chars),
        Rule("equal_lines", equal),
        Rule("word_length", (chars > 20 * n_words) | (chars < 2 * n_words)),
        Rule("bullets", t.rlike("(?m)" + BULLET) & let(filled_lines(t), lambda x: 10 * matching(x, BULLET) > 9 * F.size(x))),
        Rule("ellipses", (t.contains("...") | t.contains("\u2026")) & let(filled_lines(t), lambda x: 10 * matching(x, ELLIPSIS) > 3 * F.size(x))),
        Rule("braces", t.contains("{") & (5 * char_count(t, BRACES) > n_words)),
        Rule("broken", t.contains(BROKEN) & (50 * char_count(t, BROKEN) > chars)),
    ]


def _timed(sample: DataFrame, reject: Column) -> tuple[float, int]:
    began = time.perf_counter()
    rejected = sample.agg(F.coalesce(F.sum(F.coalesce(reject, F.lit(False)).cast("int")), F.lit(0))).first()[0]
    return time.perf_counter() - began, rejected


def sampled(df: DataFrame, text: str = "text", sample_rows: int = SAMPLE_ROWS, seed: int = 7) -> DataFrame:
    """At most sample_rows random texts, as a table of their own. Each row of each file has the same chance: enough to draw a few
    times sample_rows of them from all together, of which those of the least random numbers stay."""
    share = 4 * sample_rows / max(df.count(), 1)
    drawn = df.sample(False, share, seed) if share < 1 else df
    texts = drawn.select(F.col(text).alias("text")).filter(F.coalesce(F.octet_length("text"), F.lit(0)) <= SAMPLE_TEXT_BYTES)
    rows = texts.orderBy(F.rand(seed)).limit(sample_rows).collect()
    return df.sparkSession.createDataFrame([(r[0],) for r in rows], "text string")


def order_rules(sample: DataFrame, rules: list[Rule]) -> list[Rule]:
    """The rules by rejections per second over the sample, which has the columns that they read, the best first; ties by name."""
    rows = sample.count()
    if not rows or len(rules) < 2:
        return list(rules)
    _timed(sample, F.lit(True))
    idle = min(_timed(sample, F.lit(True))[0] for _ in range(2))
    worth = {}
    for rule in rules:
        runs = [_timed(sample, rule.reject) for _ in range(2)]
        worth[rule.name] = (runs[0][1] + 0.5) / rows / max(min(t for t, _ in runs) - idle, 1e-4)
    return sorted(rules, key=lambda r: (-worth[r.name], r.name))


def _held(sample: DataFrame) -> DataFrame:
    """The sample's rows with their columns computed once; it has SAMPLE_ROWS rows at most."""
    return sample.sparkSession.createDataFrame(sample.collect(), sample.schema)


def first_rejection(rules: list[Rule]) -> Column:
    """The name of the first rule that rejects, or null; later rules aren't computed then."""
    out = None
    for rule in rules:
        out = F.when(rule.reject, F.lit(rule.name)) if out is None else out.when(rule.reject, F.lit(rule.name))
    return F.lit(None).cast("string") if out is None else out


def cascade(df: DataFrame, rules: list[Rule] | None = None, text: str = "text", sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """df with rejected_by (string, null if kept) and kept (boolean); rules (over a column named text) in the order that the
    sample gives."""
    rules = base_rules(F.col("text")) + method_rules(F.col("text")) if rules is None else rules
    names = [r.name for r in order_rules(sampled(df, text, sample_rows), rules)]
    by_name = {r.name: r for r in rules}
    out = df if text == "text" else df.withColumn("text", F.col(text))
    out = out.withColumn("rejected_by", first_rejection([by_name[n] for n in names])).withColumn("kept", F.col("rejected_by").isNull())
    return out if text == "text" else out.drop("text")


def _word_rules(text: Column, words: Column) -> list[Rule]:
    """All rules, with the words split already."""
    return base_rules(text, words) + method_rules(text, {"n_words": F.size(words), "word_chars": F.length(F.array_join(words, ""))})


def keep(df: DataFrame, text: str = "text", sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """The rows of df, as they are, that no base or method rule rejects; all rules share one split into words."""
    sample = _held(sampled(df, text, sample_rows).withColumn("words", words_of(F.col("text"))))
    order = [r.name for r in order_rules(sample, _word_rules(F.col("text"), F.col("words")))]
    kept = lambda words: first_rejection(sorted(_word_rules(F.col(text), words), key=lambda r: order.index(r.name))).isNull()
    return df.filter(let(words_of(F.col(text)), kept))


def features(df: DataFrame, text: str = "text") -> DataFrame:
    """df with n_words, word_chars, n_symbols, n_dup_lines, n_lines (those with a word), n_repeat_words (long) and base_failed."""
    t = F.coalesce(F.col(text), F.lit(""))
    counted = let(
        words_of(t),
        lambda w: F.struct(
            F.size(w).cast("long").alias("n_words"), n_repeat_words(w).cast("long").alias("n_repeat_words"), F.length(F.array_join(w, "")).cast("long").alias("word_chars")
        ),
    )
    out = df.withColumn("__counted", counted).withColumn("__lines", let(filled_lines(t), lambda x: F.struct(F.size(x).cast("long").alias("n"), n_dup_lines(x).cast("long").alias("dup"))))
    out = out.withColumns(
        {
            "n_words": F.col("__counted.n_words"),
            "word_chars": F.col("__counted.word_chars"),
            "n_symbols": n_symbols(t).cast("long"),
            "n_dup_lines": F.col("__lines.dup"),
            "n_lines": F.col("__lines.n"),
            "n_repeat_words": F.col("__counted.n_repeat_words"),
        }
    ).drop("__counted", "__lines")
    return out.withColumn("base_failed", (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))


def judged(df: DataFrame, text: str = "text") -> DataFrame:
    """features() and kept: false if base_failed, else the verdict of the cascade over method_rules(). Rules on what features()
    counts cost nothing more and so come first; the others are computed for what is left."""
    known = {n: F.col(n) for n in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_lines")}
    order = [r.name for r in order_rules(_held(features(sampled(df, text))), method_rules(F.col("text"), known))]
    ordered = sorted(method_rules(F.col(text), known), key=lambda r: order.index(r.name))
    return features(df, text).withColumn("kept", F.when(F.col("base_failed"), F.lit(False)).otherwise(first_rejection(ordered).isNull()))
