"""Reply trees as chat texts.

Iterative self-joins find each message's root, depth and branch score; each join doubles the distance that a row looks up,
so a thread of n messages takes log n joins. Leaves are ranked by the mean score of their path, the chosen ones are expanded
to their messages by the same doubling tables, and each path becomes one text.

Template: each turn is '### ', role, a line feed, text, '</turn>' and a line feed. In roles and texts a backslash becomes
'\\b', '<' becomes '\\l', '#' becomes '\\h', and in roles a line feed becomes '\\n': nothing inside a turn can look like a
turn mark, and parse() gives back what went in.

Null role or text counts as empty. A message whose parent is null or unknown is a root. Messages on or below a cycle have no
root and are left out. Repeated ids keep their first row by (parent, score, role, text). Empty tables give empty tables; columns
that aren't named are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from emberlog.llm.native import let, running_starts
from emberlog.llm.scratch import saved

#: Fixed values of the template.
TURN, END = "### ", "</turn>\n"
CODES = (("\\", "\\b"), ("<", "\\l"), ("#", "\\h"))
MAX_ROUNDS = 40


def escape(text: Column) -> Column:
    out = F.coalesce(text, F.lit(""))
    for plain, code in CODES:
        out = F.replace(out, F.lit(plain), F.lit(code))
    return out


def unescape(text: Column) -> Column:
    for plain, code in reversed(CODES):
        text = F.replace(text, F.lit(code), F.lit(plain))
    return text


def _escape_role(role: Column) -> Column:
    return F.replace(escape(role), F.lit("\n"), F.lit("\\n"))


def format_turns(turns: Column, learned: str = "assistant") -> Column:
    """array<struct<role, text>> to struct<formatted string, mask array<struct<start, end>>>.

    mask: code points of formatted that hold the texts of the role learned, in order, end exclusive.
    """

    def of(ts: Column) -> Column:
        heads = F.transform(ts, lambda t: F.concat(F.lit(TURN), _escape_role(t["role"]), F.lit("\n")))
        bodies = F.transform(ts, lambda t: escape(t["text"]))
        parts = F.zip_with(heads, bodies, lambda h, b: F.struct(h.alias("h"), b.alias("b")))

        def built(p: Column) -> Column:
            starts = running_starts(F.transform(p, lambda x: F.length(x["h"]) + F.length(x["b"]) + len(END)))
            spans = let(
                starts,
                lambda s: F.transform(
                    p,
                    lambda x, i: F.struct(
                        (F.get(s, i) + F.length(x["h"])).alias("start"),
                        (F.get(s, i) + F.length(x["h"]) + F.length(x["b"])).alias("end"),
                        (F.get(ts, i)["role"] == learned).alias("on"),
                    ),
                ),
            )
            mask = F.transform(F.filter(spans, lambda x: F.coalesce(x["on"], F.lit(False))), lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end")))
            text = F.array_join(F.transform(p, lambda x: F.concat(x["h"], x["b"], F.lit(END))), "")
            return F.struct(text.alias("formatted"), mask.alias("mask"))

        return let(parts, built)

    return let(turns, of)


def parse(formatted: Column) -> Column:
    """What format_turns() was given: array<struct<role, text>>."""
    pieces = let(F.split(formatted, F.lit(END)), lambda x: F.slice(x, F.lit(1), F.size(x) - 1))

    def turn(piece: Column) -> Column:
        head = F.substring_index(piece, "\n", 1)
        role = unescape(F.replace(F.substr(head, F.lit(len(TURN) + 1)), F.lit("\\n"), F.lit("\n")))
        return F.struct(role.alias("role"), unescape(F.substr(piece, F.length(head) + 2)).alias("text"))

    return F.transform(pieces, turn)


def under_mask(formatted: Column, mask: Column) -> Column:
    """All text under the mask, unescaped, nothing between."""
    return F.array_join(F.transform(mask, lambda m: unescape(F.substr(formatted, m["start"] + 1, m["end"] - m["start"]))), "")


def doubling_tables(nodes: DataFrame) -> tuple[list[DataFrame], DataFrame]:
    """nodes: id, parent, score. Tables k of (id, up: the ancestor 2**k above) and the rooted nodes: id, root, depth, score.

    score of a rooted node: the sum over its path. Each round is written, so a lost executor costs one round.
    """
    known = nodes.select(F.col("id").alias("parent")).distinct()
    edges = nodes.join(known.withColumn("__known", F.lit(True)), "parent", "left").select(
        "id", F.when(F.col("__known") & (F.col("parent") != F.col("id")), F.col("parent")).alias("up"), F.col("parent").eqNullSafe(F.col("id")).alias("loop"), "score"
    )
    now = saved(edges.filter(~F.col("loop")).select("id", "up", F.when(F.col("up").isNull(), F.col("id")).alias("root"), F.lit(1).cast("long").alias("depth"), F.col("score").cast("double").alias("score")))
    tables: list[DataFrame] = []
    for _ in range(MAX_ROUNDS):
        left = now.filter(F.col("up").isNotNull())
        if left.isEmpty():
            break
        tables.append(left.select("id", "up"))
        far = now.select(F.col("id").alias("up"), F.col("up").alias("__up"), F.col("root").alias("__root"), F.col("depth").alias("__depth"), F.col("score").alias("__score"))
        further = left.join(far, "up", "left").select(
            "id",
            F.col("__up").alias("up"),
            F.coalesce("root", "__root").alias("root"),
            (F.col("depth") + F.coalesce("__depth", F.lit(0))).alias("depth"),
            (F.col("score") + F.coalesce("__score", F.lit(0.0))).alias("score"),
        )
        before, now = now, saved(now.filter(F.col("up").isNull()).unionByName(further, allowMissingColumns=False))
        if len(tables) > 1 and now.filter(F.col("root").isNotNull()).count() == before.filter(F.col("root").isNotNull()).count():
            break  # only cycles are left
    return tables, now.filter(F.col("root").isNotNull()).select("id", "root", "depth", "score")


def reply_paths(nodes: DataFrame, per_tree: int = 1) -> DataFrame:
    """nodes: id, parent, score. The best per_tree root-to-leaf paths of each tree, by mean score, then depth, then leaf id.

    One row for each message on a path: root, leaf, branch_rank (from 1), branch_score, id, above (0 at the leaf).
    """
    nodes = saved(nodes.select("id", "parent", "score").filter(F.col("id").isNotNull()).groupBy("id").agg(F.min(F.struct("parent", "score")).alias("x")).select("id", "x.parent", "x.score"))
    tables, rooted = doubling_tables(nodes)
    leaves = rooted.join(nodes.select(F.col("parent").alias("id")).filter(F.col("id").isNotNull()).distinct(), "id", "left_anti")
    rank = Window.partitionBy("root").orderBy(F.desc(F.col("score") / F.col("depth")), F.desc("depth"), "id")
    chosen = leaves.withColumn("branch_rank", F.row_number().over(rank)).filter(F.col("branch_rank") <= per_tree)
    paths = chosen.select("root", F.col("id").alias("leaf"), "branch_rank", (F.col("score") / F.col("depth")).alias("branch_score"), "id", F.lit(0).cast("long").alias("above"))
    for k in reversed(range(len(tables))):
        pair = F.array(F.struct("id", "above"), F.struct(F.col("up").alias("id"), (F.col("above") + F.lit(1 << k)).alias("above")))
        both = paths.join(tables[k], "id", "left").select("root", "leaf", "branch_rank", "branch_score", F.explode(F.filter(pair, lambda x: x["id"].isNotNull())).alias("x"))
        paths = both.select("root", "leaf", "branch_rank", "branch_score", "x.id", "x.above")
    return paths


def format_trees(messages: DataFrame, per_tree: int = 1, learned: str = "assistant") -> DataFrame:
    """messages: id, parent, score, role, text. One row for each chosen path: root, leaf, branch_rank, branch_score, formatted, mask."""
    messages = messages.filter(F.col("id").isNotNull()).groupBy("id").agg(F.min(F.struct("parent", "score", "role", "text")).alias("x")).select("id", "x.parent", "x.score", "x.role", "x.text")
    messages = saved(messages)
    paths = reply_paths(messages, per_tree)
    turns = paths.join(messages.select("id", "role", "text"), "id")
    grouped = turns.groupBy("root", "leaf", "branch_rank", "branch_score").agg(F.sort_array(F.collect_list(F.struct((-F.col("above")).alias("at"), "role", "text"))).alias("turns"))
    out = grouped.withColumn("__f", format_turns(F.transform("turns", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))), learned))
    return out.select("root", "leaf", "branch_rank", "branch_score", F.col("__f.formatted").alias("formatted"), F.col("__f.mask").alias("mask"))


def linear_threads(conversations: DataFrame) -> DataFrame:
    """conversations: conv_id, turn, role, text. Each row replies to the one before it: id, parent, score, role, text.

    Order: turn, role, text; rows without a conv_id form one conversation. id: conv_id and place, joined by ':'.
    """
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_last(), "role", "text")
    at = F.row_number().over(order)
    name = lambda n: F.concat_ws(":", F.coalesce(F.col("conv_id").cast("string"), F.lit("")), n.cast("string"))
    return conversations.withColumn("__at", at).select(
        name(F.col("__at")).alias("id"), F.when(F.col("__at") > 1, name(F.col("__at") - 1)).alias("parent"), F.lit(1.0).alias("score"), "role", "text"
    )
