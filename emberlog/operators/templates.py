"""Template mining: masks, a fixed-depth search tree over messages, parameters, reconstruction, simplification.

Mining is online and order-dependent by nature. Messages of different components, or of different numbers of tokens, never
meet in the tree, so each such group is mined by itself, in the order of its rows, in runs of a bounded number of rows whose trees
are merged. A tree is a mergeable state: its clusters with their templates and leaves, in the order of their founding. Then each
different masked message is matched, and rows get their template in a join and their parameters in Arrow batches. Masks,
reconstruction and simplification are plain columns.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterable, Iterator, Sequence

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from emberlog.functions.patterns import PATTERNS, PRESETS, Mask, MiningSettings
from emberlog.functions.text import FLAGS, stable_hash
from emberlog.operators.joins import joined
from emberlog.operators.places import placed
from emberlog.sources.written import saved

WILD = "<*>"
MOST_CHILDREN = 100
#: Rows of a component that one task learns from, trees that merge at once, and messages that are matched in one group.
CHUNK_ROWS, FAN, MATCH_ROWS = 500_000, 16, 100_000
#: Of different messages with their templates, which are broadcast up to that size.
BROADCAST_CHARACTERS = 32_000_000
_PLACE = re.compile(r"<(\*|[A-Za-z_@][\w@]*)>")


def masked(message: Column, masks: Sequence[Mask]) -> Column:
    """Each match of each mask, in order, replaced by '<name>'."""
    for name, pattern in masks:
        message = F.regexp_replace(message, FLAGS + pattern, f"<{name}>")
    return message


class TemplateTree:
    """Clusters of token sequences by length, first tokens and similarity."""

    def __init__(self, similarity: float = 0.4, depth: int = 4) -> None:
        if depth < 3:
            raise ValueError("depth is 3 at least")
        self._similarity, self._levels = similarity, depth - 3
        self._changes = 0
        self.leaf_of: list[tuple] = []
        self._leaves: dict[tuple, list[int]] = {}
        self._children: dict[tuple, set[str]] = {}
        self._lengths: dict[int, list[int]] = {}
        self.templates: list[list[str]] = []

    @staticmethod
    def _likeness(template: list[str], tokens: list[str], wild_counts: bool, merging: bool) -> tuple[float, int]:
        """Of a template and tokens; merging: the tokens are a template, whose wild places equal wild places."""
        if not tokens:
            return 1.0, 0
        wild = sum(t == WILD for t in template)
        same = sum(a == b and (merging or a != WILD) for a, b in zip(template, tokens, strict=True))
        return (same + wild * wild_counts) / len(tokens), wild

    def _nearest(self, ids: Iterable[int], tokens: list[str], least: float, wild_counts: bool, merging: bool = False) -> int | None:
        best, at = (-1.0, -1), None
        for i in ids:
            likeness = self._likeness(self.templates[i], tokens, wild_counts, merging)
            if likeness > best:
                best, at = likeness, i
        return at if best[0] >= least else None

    def _path(self, tokens: list[str]) -> tuple | None:
        path: tuple = (len(tokens),)
        for token in tokens[: min(self._levels, max(len(tokens) - 1, 0))]:
            children = self._children.get(path, ())
            step = token if token in children else WILD
            if step not in children:
                return None
            path += (step,)
        return path

    def _grow(self, tokens: list[str]) -> tuple:
        path: tuple = (len(tokens),)
        for token in tokens[: min(self._levels, max(len(tokens) - 1, 0))]:
            children = self._children.setdefault(path, set())
            if token not in children:
                room = len(children) + (WILD not in children) < MOST_CHILDREN
                if any(c.isdigit() for c in token) or not room:
                    token = WILD
                children.add(token)
            path += (token,)
        return path

    def _added(self, tokens: list[str], path: tuple) -> int:
        at = len(self.templates)
        self.templates.append(tokens)
        self.leaf_of.append(path)
        self._leaves.setdefault(path, []).append(at)
        self._lengths.setdefault(len(tokens), []).append(at)
        self._changes += 1
        return at

    def learn_tokens(self, tokens: list[str], merging: bool = False) -> int:
        """The number of the tokens' cluster, which they may widen or found; merging: they are a template."""
        path = self._path(tokens)
        at = None if path is None else self._nearest(self._leaves.get(path, ()), tokens, self._similarity, False, merging)
        if at is None:
            return self._added(tokens, self._grow(tokens))
        wider = [a if a == b else WILD for a, b in zip(self.templates[at], tokens, strict=True)]
        self._changes += wider != self.templates[at]
        self.templates[at] = wider
        return at

    def learn(self, message: str) -> int:
        """The number of the message's cluster, which it may widen or found."""
        return self.learn_tokens(message.split())

    def learn_all(self, messages: Iterable[str]) -> list[int]:
        """Learns all in order, and tells which of them (by place) founded the clusters.

        A message that has come before, with no change to the tree since, would change nothing, and is passed over.
        """
        founded, seen = [], {}
        for i, message in enumerate(messages):
            if seen.get(message) == self._changes:
                continue
            tokens = message.split()
            if self.learn_tokens(tokens) == len(founded):
                founded.append(i)
            # Tokens that look like wild places equal nothing, not even themselves.
            if WILD not in tokens:
                seen[message] = self._changes
        return founded

    def restore(self, tokens: list[str], leaf: tuple) -> None:
        """A cluster of another tree, in its leaf; clusters come in the order of their founding."""
        for n in range(1, len(leaf)):
            self._children.setdefault(leaf[:n], set()).add(leaf[n])
        self._added(tokens, leaf)

    def match(self, message: str) -> int | None:
        """The cluster whose template holds the message: by the tree, else among all of its length."""
        tokens = message.split()
        path = self._path(tokens)
        at = None if path is None else self._nearest(self._leaves.get(path, ()), tokens, 1.0, True)
        return self._nearest(self._lengths.get(len(tokens), ()), tokens, 1.0, True) if at is None else at


@functools.lru_cache(maxsize=10_000)
def _patterns(template: str, masks: tuple[Mask, ...]) -> tuple[tuple[str, ...], list[re.Pattern]]:
    """The masks of a template's places, and patterns with a group for each: by the masks' own patterns, and by anything."""
    named: dict[str, list[str]] = {}
    for name, pattern in masks:
        named.setdefault(name, []).append(pattern)
    names = tuple(m[1] for m in _PLACE.finditer(template))
    out = []
    for loose in (False, True):
        built, last = "", 0
        for i, m in enumerate(_PLACE.finditer(template)):
            built += re.sub(r"(?:\\ |\s)+", r"\\s+", re.escape(template[last : m.start()]))
            options = ["(?:" + p.lstrip("^") + ")" for p in named.get(m[1], [])]
            built += f"(?P<p{i}>{'|'.join(options) if options and not loose else '.+?'})"
            last = m.end()
        built += re.sub(r"(?:\\ |\s)+", r"\\s+", re.escape(template[last:]))
        out.append(re.compile(r"\s*" + built + r"\s*", re.S))
    return names, out


def parameters_of(template: str, message: str, masks: Sequence[Mask]) -> list[tuple[str, str]]:
    """(value, mask) of each place of the template in the unmasked message."""
    names, patterns = _patterns(template, tuple(masks))
    if not names:
        return []
    for pattern in patterns:
        found = pattern.fullmatch(message)
        if found:
            return [(found[f"p{i}"], name) for i, name in enumerate(names)]
    return []


def mine_messages(messages: Sequence[str], settings: MiningSettings) -> tuple[list[tuple[int, list[tuple[str, str]]]], dict[int, str]]:
    """For each message its event id (from 1) and parameters; the template of each id."""
    rules = [(name, re.compile(pattern)) for name, pattern in settings.masks]

    def hide(text: str) -> str:
        for name, pattern in rules:
            text = pattern.sub(f"<{name}>", text)
        return text

    hidden = [hide(m) for m in messages]
    tree = TemplateTree(settings.similarity, settings.depth)
    for h in hidden:
        tree.learn(h)
    templates = {i + 1: " ".join(t) for i, t in enumerate(tree.templates)}
    known: dict[str, int] = {}
    out = []
    for raw, h in zip(messages, hidden, strict=True):
        if h not in known:
            known[h] = (tree.match(h) or 0) + 1
        out.append((known[h], parameters_of(templates[known[h]], raw, settings.masks)))
    return out, templates


_PARAMETERS = pa.list_(pa.struct([("value", pa.string()), ("mask", pa.string())]))


def _with_parameters(rows: DataFrame, settings: MiningSettings, message: str) -> DataFrame:
    """Adds parameters, read from each message by its template; equal messages of a batch are read once. It is a column, so plans
    that don't use it don't run it."""
    masks = settings.masks

    @F.arrow_udf("array<struct<value: string, mask: string>>")
    def read(template: pa.Array, said: pa.Array) -> pa.Array:
        known: dict[tuple, list] = {}
        found = []
        for pair in zip(template.to_pylist(), said.to_pylist(), strict=True):
            if pair not in known:
                known[pair] = [{"value": v, "mask": n} for v, n in parameters_of(pair[0], pair[1] or "", masks)]
            found.append(known[pair])
        return pa.array(found, _PARAMETERS)

    return rows.withColumn("parameters", read("template", message))


def _first(table: pa.Table, names: Sequence[str]) -> dict[str, pa.Array]:
    return {n: table.column(n).combine_chunks().slice(0, 1) for n in names}


def _repeated(one: dict[str, pa.Array], times: int) -> dict[str, pa.Array]:
    return {n: pa.concat_arrays([a] * times) if times else a.slice(0, 0) for n, a in one.items()}


def _cluster_columns(tree: TemplateTree) -> dict[str, pa.Array]:
    n = len(tree.templates)
    return {"rank": pa.array(range(n), pa.int64()), "template": pa.array([" ".join(t) for t in tree.templates], pa.string()), "leaf": pa.array([list(map(str, leaf[1:])) for leaf in tree.leaf_of], pa.list_(pa.string()))}


def _restored(table: pa.Table, settings: MiningSettings) -> TemplateTree:
    tree = TemplateTree(settings.similarity, settings.depth)
    for template, leaf in zip(table.column("template").to_pylist(), table.column("leaf").to_pylist(), strict=True):
        tokens = template.split()
        tree.restore(tokens, (len(tokens), *leaf))
    return tree


def _clusters(slim: DataFrame, settings: MiningSettings, places: Sequence[str], chunk_rows: int, fan: int) -> DataFrame:
    """Clusters of slim (c, len, masked and places): c, len, the places of the row that founded each, rank, template and leaf.

    Each component's rows are cut into runs of chunk_rows in their order. Trees learn from the rows of a run that have one length,
    and then merge, fan by fan in order: a later tree's templates are learned by the earlier one, wild places equal to wild places.
    """
    most = slim.groupBy("c").count().agg(F.max("count")).first()[0] or 0
    if most > chunk_rows:
        slim = placed(slim, ["c"], places, into="__place").withColumn("chunk", F.floor(F.col("__place") / chunk_rows)).drop("__place")
    else:
        slim = slim.withColumn("chunk", F.lit(0).cast("long"))
    keys = ["c", "len", "chunk"]
    schema = StructType([*slim.select(*keys, *places).schema.fields, *StructType.fromDDL("rank long, template string, leaf array<string>").fields])
    names = schema.names

    def learn(table: pa.Table) -> pa.Table:
        table = table.take(pc.sort_indices(table, sort_keys=[(p, "ascending") for p in places], null_placement="at_start"))
        tree = TemplateTree(settings.similarity, settings.depth)
        founded = pa.array(tree.learn_all(table.column("masked").to_pylist()), pa.int64())
        out = _repeated(_first(table, keys), len(founded)) | {p: table.column(p).combine_chunks().take(founded) for p in places} | _cluster_columns(tree)
        return pa.table({n: out[n] for n in names})

    def merge(table: pa.Table) -> pa.Table:
        table = table.sort_by([("chunk", "ascending"), ("rank", "ascending")])
        first = table.filter(pc.equal(table.column("chunk"), table.column("chunk")[0]))
        tree, founded = _restored(first, settings), list(range(first.num_rows))
        for i, template in enumerate(table.column("template").to_pylist()[first.num_rows :], first.num_rows):
            if tree.learn_tokens(template.split(), True) == len(founded):
                founded.append(i)
        one = _first(table, keys) | {"chunk": pa.array([table.column("chunk")[0].as_py() // fan])}
        out = _repeated(one, len(founded)) | {p: table.column(p).combine_chunks().take(pa.array(founded)) for p in places} | _cluster_columns(tree)
        return pa.table({n: out[n] for n in names})

    now, last = saved(slim.groupBy(*keys).applyInArrow(learn, schema)), (most - 1) // chunk_rows
    while last > 0:
        now, last = saved(now.groupBy("c", "len", F.floor(F.col("chunk") / fan)).applyInArrow(merge, schema)), last // fan
    return now


def _matched(distinct: DataFrame, clusters: DataFrame, settings: MiningSettings, match_rows: int) -> DataFrame:
    """c, len, masked and rank: the cluster of each different masked message. The messages of a component and length are dealt to as
    many groups as they need, and each gets that component and length's clusters."""
    shares = distinct.groupBy("c", "len").agg(F.ceil(F.count("*") / match_rows).cast("int").alias("groups"))
    shares = saved(shares)
    salted = joined(distinct, shares, ["c", "len"]).withColumn("salt", F.pmod(F.hash("masked"), F.col("groups"))).drop("groups")
    spread = joined(clusters.select("c", "len", "rank", "template", "leaf"), shares, ["c", "len"]).select("*", F.explode(F.sequence(F.lit(0), F.col("groups") - 1)).alias("salt")).drop("groups")
    schema = StructType([*distinct.select("c", "len", "masked").schema.fields, *StructType.fromDDL("rank long").fields])

    def match(messages: pa.Table, known: pa.Table) -> pa.Table:
        if not messages.num_rows:
            return messages.select(["c", "len", "masked"]).append_column("rank", pa.array([], pa.int64()))
        tree = _restored(known.sort_by("rank"), settings)
        found = [tree.match(m) or 0 for m in messages.column("masked").to_pylist()]
        return messages.select(["c", "len", "masked"]).append_column("rank", pa.array(found, pa.int64()))

    return salted.groupBy("c", "len", "salt").cogroup(spread.groupBy("c", "len", "salt")).applyInArrow(match, schema)


def _mined(entries: DataFrame, settings: MiningSettings | str, component: str, order: Sequence[str], message: str, keep: Sequence[str], repeats: bool, chunk_rows: int, fan: int, match_rows: int) -> DataFrame:
    settings = PRESETS[settings] if isinstance(settings, str) else settings
    columns = list(dict.fromkeys([component, *order, *keep, message]))
    # Written once: sizes, trees, different messages and rows with their events are read from it, and what is above runs once.
    rows = saved(entries.select(*columns).withColumn("__masked", masked(F.coalesce(F.col(message), F.lit("")), settings.masks)))
    places = [f"o{i}" for i in range(len(order))]
    # As many groups as there are different numbers of words; trees count for themselves.
    words = F.size(F.filter(F.split("__masked", r"(?U)[\s\x1c-\x1f]+"), lambda w: w != ""))
    slim = rows.select(F.col(component).alias("c"), words.alias("len"), F.col("__masked").alias("masked"), *[F.col(c).alias(p) for c, p in zip(order, places, strict=True)])
    if not repeats:
        slim = slim.groupBy("c", "len", "masked").agg(F.min(F.struct(*places)).alias("first")).select("c", "len", "masked", "first.*")
    clusters = _clusters(slim, settings, places, chunk_rows, fan)
    # An event is a cluster of a component, numbered by the row that founded it. Clusters are few.
    number = F.row_number().over(Window.partitionBy("c").orderBy(*places, "len")).cast("long")
    clusters = clusters.withColumn("event", number)
    distinct = saved(slim.select("c", "len", "masked").distinct())
    told = joined(_matched(distinct, clusters, settings, match_rows), clusters.select("c", "len", "rank", "event", "template"), ["c", "len", "rank"])
    told = saved(told.select(F.col("c").alias(f"__{component}"), F.col("masked").alias("__known"), "event", "template"))
    # Different messages are mostly far fewer than rows; sent to all tasks while they are few, they leave rows where they are.
    size = told.agg(F.sum(F.length("__known") + F.length("template") + 64)).first()[0] or 0
    met = rows.join(F.broadcast(told) if size <= BROADCAST_CHARACTERS else told, F.col(component).eqNullSafe(F.col(f"__{component}")) & (F.col("__masked") == F.col("__known")))
    return _with_parameters(met.select(*columns, "event", "template"), settings, message)


def mine_templates(
    entries: DataFrame, settings: MiningSettings | str = "hadoop", component: str = "component", order: Sequence[str] = ("pos",), message: str = "message", keep: Sequence[str] = (), chunk_rows: int = CHUNK_ROWS, fan: int = FAN, match_rows: int = MATCH_ROWS
) -> DataFrame:
    """component, order and keep columns, message, event (from 1 in each component, by the first message of each cluster), template,
    parameters (value, mask). order must tell the rows of a component apart.

    A component of at most chunk_rows rows is mined as one tree would mine it, row by row in order. Longer ones are mined in runs of
    that many rows, whose trees merge in order; a run's clusters then widen or join those before them as messages would.
    """
    return _mined(entries, settings, component, order, message, keep, True, chunk_rows, fan, match_rows)


def mine_distinct(
    entries: DataFrame, settings: MiningSettings | str = "hadoop", component: str = "component", order: Sequence[str] = ("pos",), message: str = "message", keep: Sequence[str] = (), chunk_rows: int = CHUNK_ROWS, fan: int = FAN, match_rows: int = MATCH_ROWS
) -> DataFrame:
    """As mine_templates(), but trees learn from the different masked messages of a component, in the order of their first places.

    A message that comes again doesn't widen templates further, so templates can be narrower than those of mine_templates().
    """
    return _mined(entries, settings, component, order, message, keep, False, chunk_rows, fan, match_rows)


def event_dictionary(mined: DataFrame, component: str = "component") -> DataFrame:
    return mined.select(component, "event", "template").distinct()


def reconstruct(template: Column, values: Column) -> Column:
    """The template's places filled with values, from left to right."""
    pieces = F.split(template, r"<(?:\*|[A-Za-z_@][\w@]*)>", -1)
    filled = F.concat(F.transform(values, lambda v: F.coalesce(v, F.lit(""))), F.array_repeat(F.lit(""), F.greatest(F.size(pieces) - F.size(values), F.lit(0))))
    return F.array_join(F.zip_with(pieces, F.slice(filled, F.lit(1), F.size(pieces)), lambda p, v: F.concat(p, F.coalesce(v, F.lit("")))), "")


def _hex_rest(digits: Column, modulus: int) -> Column:
    """A hexadecimal number of any length modulo a number."""
    parts = F.regexp_extract_all(digits, F.lit("[0-9a-fA-F]{1,8}"), F.lit(0))
    return F.aggregate(parts, F.lit(0).cast("long"), lambda a, x: (a * F.pow(F.lit(16), F.length(x)).cast("long") + F.conv(x, 16, 10).cast("long")) % modulus)


def _whole_hex(digits: Column) -> Column:
    """A hexadecimal number in decimal digits: exact up to 31 digits, longer ones stay as they are."""
    parts = F.regexp_extract_all(F.lpad(digits, 32, "0"), F.lit("[0-9a-fA-F]{8}"), F.lit(0))
    wide = F.aggregate(parts, F.lit(0).cast("decimal(38,0)"), lambda a, x: (a * F.lit(4294967296).cast("decimal(11,0)") + F.conv(x, 16, 10).cast("decimal(11,0)")).cast("decimal(38,0)"))
    return F.when(F.length(digits) <= 15, F.conv(digits, 16, 10)).when(F.length(digits) <= 31, wide.cast("string")).otherwise(digits)


def simplified(value: Column, mask: Column) -> Column:
    """A short stand-in for a parameter, by the name of its mask; the first rule that fits counts."""
    code = stable_hash(value, 100_000)
    words = F.regexp_extract_all(value, F.lit(r"(?U)\w+"), F.lit(0))
    last_part = F.element_at(F.filter(F.split(value, r"\."), lambda p: p.rlike(r"(?U)^\w")), -1)
    numbers = F.regexp_extract_all(value, F.lit(r"[-+]?[\dxa-fA-F.]+"), F.lit(0))
    counted = F.transform(F.array_distinct(numbers), lambda x: F.struct((-F.size(F.filter(numbers, lambda y: y == x))).alias("n"), F.array_position(numbers, x).alias("at"), x.alias("x")))
    common = F.array_join(F.transform(F.slice(F.array_sort(counted), 1, 3), lambda s: s["x"]), ", ")
    hex_digits = F.regexp_replace(value, "^0[xX]", "")
    letters = F.regexp_extract_all(value, F.lit(r"[a-zA-Z]+[:=.?!]?"), F.lit(0))
    longest = F.array_min(F.transform(letters, lambda x: F.struct((-F.length(x)).alias("n"), F.array_position(letters, x).alias("at"), x.alias("x"))))["x"]
    plain = F.when(value.rlike(r"^\s*[-+]?\d+\s*$") | value.try_cast("double").isNotNull(), value).otherwise(F.coalesce(longest, F.lit("")))
    return (
        F.when(mask == "java_identifier", F.coalesce(F.regexp_extract(last_part, r"(?U)^\w+", 0), value))
        .when(mask.endswith("_path"), F.when(F.size(words) > 0, F.concat(F.element_at(words, -1), F.lit("-path"))).otherwise(F.lit("path")))
        .when(mask.endswith("_uri") | mask.endswith("_url"), F.concat(F.lower(F.regexp_replace(mask, "_ur[il]$", "")), F.lit("-"), F.upper(F.right(mask, F.lit(3)))))
        .when(mask.endswith("_id"), F.concat(F.regexp_replace(mask, "_id$", ""), F.lit("#"), code.cast("string")))
        .when(mask.rlike("^(?:ipv4_address|ipv6_address|mac_address)"), F.concat(F.lit("remote host #"), code.cast("string")))
        .when(mask == "long_numerical_list", common)
        .when(mask == "hex_number", _whole_hex(hex_digits))
        .when(mask == "hex_segment", F.lower(F.hex(_hex_rest(value, 100_000))))
        .when(mask == "hex_identifier", F.lower(F.hex(code)))
        .when(mask.startswith("number"), value)
        .otherwise(plain)
    )


def with_simplified_message(mined: DataFrame, into: str = "simplified") -> DataFrame:
    """Adds the message rebuilt from its template and simplified parameters."""
    return mined.withColumn(into, reconstruct(F.col("template"), F.transform("parameters", lambda p: simplified(p["value"], p["mask"]))))


__all__ = ["PATTERNS", "TemplateTree", "event_dictionary", "masked", "mine_distinct", "mine_messages", "mine_templates", "parameters_of", "reconstruct", "simplified", "with_simplified_message"]
