"""Traces: markers in messages, forests of spans, paths, flattening, graphs.

A trace tuple is (pos, trace, parent, span). In each trace, the last parent given for a span (other than itself) counts; a
parent that has no row of its own is a root. Spans on cycles can't be reached from a root and are left out of paths.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from emberlog.functions.text import natural_key
from emberlog.operators.joins import joined
from emberlog.operators.ordering import consecutive_distinct
from emberlog.operators.places import placed
from emberlog.sources.written import saved

_BELOW = "\u0001"
_MARKER = r"\[([0-9a-fA-F]+), ?([0-9a-fA-F]+), ?([0-9a-fA-F]+)\]"


def from_markers(entries: DataFrame, message: str = "message", prefix_only: bool = True, remove: bool = False) -> DataFrame:
    """Adds trace, span and parent from '[trace, span, parent]'; rows without a marker go. remove takes it out of the message."""
    pattern = ("^" if prefix_only else "") + _MARKER
    rows = entries.filter(F.col(message).rlike(pattern))
    out = rows.withColumns({n: F.regexp_extract(message, pattern, i + 1) for i, n in enumerate(("trace", "span", "parent"))})
    if not remove:
        return out
    left, right = F.regexp_extract(message, rf"(?s)^(.*?){_MARKER}(.*)$", 1), F.regexp_replace(F.regexp_extract(message, rf"(?s)^(.*?){_MARKER}(.*)$", 5), r"(?U)^\s+", "")
    return out.withColumn(message, F.when(right == "", F.regexp_replace(left, r"(?U)\s+$", "")).otherwise(F.concat(left, right)))


def from_columns(entries: DataFrame, trace: str, parent: str, span: str, drop: bool = False) -> DataFrame:
    """Adds trace, parent and span from columns of their own."""
    out = entries.withColumns({"trace": F.col(trace).cast("string"), "parent": F.col(parent).cast("string"), "span": F.col(span).cast("string")})
    return out.drop(*[c for c in (trace, parent, span) if drop and c not in ("trace", "parent", "span")])


def forest(tuples: DataFrame, pos: str = "pos") -> DataFrame:
    """trace, span, parent (null for roots), looped (a row of the span names itself as parent): one row for each span."""
    own = tuples.groupBy("trace", "span").agg(
        F.max_by("parent", F.when(F.col("parent") != F.col("span"), F.col(pos))).alias("parent"), F.max(F.col("parent") == F.col("span")).alias("looped")
    )
    heads = tuples.select("trace", F.col("parent").alias("span")).distinct()
    heads = joined(heads, own, ["trace", "span"], "left_anti")
    roots = heads.select("trace", "span", F.lit(None).cast("string").alias("parent"), F.lit(False).alias("looped"))
    return own.unionByName(roots)


def paths(spans: DataFrame, piece: Column | None = None, separator: str = "/") -> DataFrame:
    """trace, span, depth (0 for a trace's top spans) and path (span ids, or pieces, joined by the separator) of all spans that a root
    reaches.

    Each round joins every span that hasn't come to its root with the piece of path that ends at its topmost known ancestor,
    so pieces double in length and a depth of n takes log n rounds. Each round is written; spans that have come to their root
    aren't touched again. When a round brings none home, all that are left hang on cycles.
    """
    begun = spans.select("trace", "span", F.col("parent").alias("up"), F.lit(1).cast("long").alias("spans"), (F.col("span") if piece is None else piece).alias("path"))
    now, done = saved(begun), None
    while True:
        home = now.filter(F.col("up").isNull())
        done = home if done is None else done.unionByName(home)
        far = done.unionByName(now.filter(F.col("up").isNotNull())).select(F.col("trace").alias("__trace"), F.col("span").alias("__span"), F.col("up").alias("__up"), F.col("spans").alias("__spans"), F.col("path").alias("__path"))
        joined = now.filter(F.col("up").isNotNull()).join(far, F.col("trace").eqNullSafe(F.col("__trace")) & (F.col("up") == F.col("__span")))
        now = saved(joined.select("trace", "span", F.col("__up").alias("up"), (F.col("spans") + F.col("__spans")).alias("spans"), F.concat("__path", F.lit(separator), "path").alias("path")))
        if now.filter(F.col("up").isNull()).isEmpty():
            break
    return done.select("trace", "span", (F.col("spans") - 1).alias("depth"), "path")


def in_tree_order(spans: DataFrame, into: str = "row") -> DataFrame:
    """trace, span, depth and row (from 0 in each trace) of all spans that a root reaches, as a tree is shown: parents before their
    children, children of one parent by the natural order of their ids.

    A span's sort key is made of the natural keys of all its ancestors, which the rounds of paths() join; numbers then come from
    tasks' ranges, so a trace of any size is spread over tasks.
    """
    # The separator sorts before all that ids are made of, so a parent's children come before its next sibling.
    keyed = paths(spans, natural_key(F.col("span")), _BELOW)
    return placed(keyed, ["trace"], ["path", "span"], into=into).drop("path")


def find(spans: DataFrame, span: str) -> DataFrame:
    """Paths to a span, with the trace in front."""
    return paths(spans).filter(F.col("span") == span).select(F.concat_ws("/", "trace", "path").alias("path"))


def flatten(spans: DataFrame, tuples: DataFrame, values: Sequence[str], default_parent: str | None = None) -> DataFrame:
    """trace, parent, span and the values of each row of a span, one row for a span without; spans without a parent get the
    default or go."""
    named = spans.withColumn("parent", F.coalesce("parent", F.lit(default_parent))) if default_parent is not None else spans.filter(F.col("parent").isNotNull())
    return joined(named.select("trace", "parent", "span"), tuples.select("trace", "span", *values), ["trace", "span"], "left").select("trace", "parent", "span", *values)


def graph(spans: DataFrame, tuples: DataFrame | None = None, keep: Sequence[str] = (), pos: str = "pos") -> tuple[DataFrame, DataFrame]:
    """nodes (trace, node, kind) with one for each trace, and edges (trace, src, dst).

    keep: columns of tuples that nodes retain, as attributes (one struct for each row of the span, in order; empty for traces and
    for spans without rows).
    """
    nodes = spans.select("trace", F.col("span").alias("node"), F.lit("span").alias("kind"))
    nodes = nodes.unionByName(spans.select("trace", F.col("trace").alias("node"), F.lit("trace").alias("kind")).distinct())
    if tuples is not None and keep:
        rows = F.sort_array(F.collect_list(F.struct(F.col(pos).alias("__at"), F.struct(*keep).alias("__row"))))
        held = tuples.groupBy("trace", F.col("span").alias("node")).agg(F.transform(rows, lambda r: r["__row"]).alias("attributes")).withColumn("kind", F.lit("span"))
        nodes = joined(nodes, held, ["trace", "node", "kind"], "left")
        none = F.array().cast(held.schema["attributes"].dataType)
        nodes = nodes.withColumn("attributes", F.coalesce("attributes", none))
    return nodes, spans.select("trace", F.coalesce("parent", "trace").alias("src"), F.col("span").alias("dst"))


def constructed(nodes: DataFrame, edges: DataFrame, build: Callable[[pa.Table, pa.Table], pa.Table], schema: str) -> DataFrame:
    """What build makes of each trace's nodes and edges: a caller's own graph, measured or written out, as rows of schema. A trace is
    one call, so its graph has to fit a task."""
    # Both may come from the same rows; new names of the same kind tell their columns apart.
    own = edges.select(*(F.col(c).alias(c) for c in edges.columns))
    return nodes.groupBy("trace").cogroup(own.groupBy("trace")).applyInArrow(build, schema)


def shown(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges that leave a node that is shown."""
    return joined(edges, nodes.select("trace", F.col("node").alias("src")), ["trace", "src"], "left_semi")


def labels(tuples: DataFrame, column: str, pos: str = "pos", distinct_lines: bool = False) -> DataFrame:
    """trace, span and label: the lines of a column for each span in order; distinct_lines leaves out equal neighbours."""
    rows = consecutive_distinct(tuples, ["trace", "span"], [pos], column) if distinct_lines else tuples
    lines = F.sort_array(F.collect_list(F.struct(F.col(pos).alias("at"), F.col(column).alias("line"))))
    return rows.groupBy("trace", "span").agg(lines.alias("__l")).select("trace", "span", F.array_join(F.transform("__l", lambda x: x["line"]), "\n").alias("label"))


def wrapped(text: Column, width: int) -> Column:
    """text with its words on lines of at most width characters (longer words stand alone)."""
    words = F.filter(F.split(text, r"\s+"), lambda w: w != "")
    state = "struct<done: string, line: string>"

    def step(a: Column, w: Column) -> Column:
        longer = F.concat(a["line"], F.lit(" "), w)
        fits = F.struct(a["done"].alias("done"), F.when(a["line"] == "", w).otherwise(longer).alias("line")).cast(state)
        turn = F.struct(F.concat(a["done"], a["line"], F.lit("\n")).alias("done"), w.alias("line")).cast(state)
        return F.when((a["line"] == "") | (F.length(longer) <= width), fits).otherwise(turn)

    return F.aggregate(words, F.struct(F.lit("").alias("done"), F.lit("").alias("line")).cast(state), step, lambda a: F.concat(a["done"], a["line"]))


def depth_window(spans: DataFrame) -> DataFrame:
    """Children of each span, numbered by id."""
    return spans.withColumn("child", F.row_number().over(Window.partitionBy("trace", "parent").orderBy("span")))
