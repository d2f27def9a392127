"""From lines to entries, with three policies for lines that don't fit: abort, skip, append."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from emberlog.functions.text import strip
from emberlog.sources.formats import LineFormat, compile_format


#: Stands between the fields of a matched line.
_SEAM = "\u0001"


def _pieces(line: Column, fmt: LineFormat) -> Column:
    """'', the groups of all fields and what follows the match, of a line that fits; else the line alone. The pattern is matched
    once for all fields, but for lines that hold the seam themselves; and not where a character lacks that all lines have, as telling
    by the pattern that a line doesn't fit takes the longest."""
    marked = _SEAM + "".join(f"${g}{_SEAM}" for g in fmt.groups)
    one_by_one = F.array(F.lit(""), *[F.regexp_extract(line, fmt.pattern, g) for g in fmt.groups], F.lit(""))
    slow = F.when(line.rlike(fmt.pattern), one_by_one).otherwise(F.array(line))
    told = F.when(line.contains(_SEAM), slow)
    for c in sorted(fmt.needed):
        told = told.when(~line.contains(c), F.array(line))
    return told.otherwise(F.split(F.regexp_replace(line, fmt.pattern, marked), _SEAM))


def parse(lines: DataFrame, log_format: str | LineFormat, line: str = "line", trimmed: bool = True) -> DataFrame:
    """Adds the fields and is_valid; the fields of a line that doesn't fit are null. Fields of absent optional parts are null."""
    fmt = log_format if isinstance(log_format, LineFormat) else compile_format(log_format)
    out = lines.withColumn("__pieces", _pieces(F.col(line), fmt))
    out = out.withColumn("is_valid", F.coalesce(F.size("__pieces") == len(fmt.fields) + 2, F.lit(False)))

    def field(i: int, name: str) -> Column:
        value = F.get(F.col("__pieces"), F.lit(i + 1))
        value = strip(value) if trimmed else value
        return F.when(F.col("is_valid"), F.nullif(value, F.lit("")) if name in fmt.optional else value).alias(name)

    return out.select(*lines.columns, "is_valid", *[field(i, name) for i, name in enumerate(fmt.fields)])


def structure(
    lines: DataFrame, log_format: str, on_error: str = "abort", file: str = "file", line_no: str = "line_no", line: str = "line", append_to: str | None = None, separator: str = "\n", keep_line: bool = False
) -> DataFrame:
    """Entries of all lines that fit; lines: file, line_no, line.

    on_error: 'abort' fails on a line that doesn't fit (the first that any task meets); 'skip' leaves such lines out; 'append' joins them (stripped),
    each after a separator, to the field append_to of the last entry before them in their file, and fails if there is none.
    """
    parsed = parse(lines, log_format, line)
    drop = ["is_valid"] if keep_line else ["is_valid", line]
    said = F.concat(F.lit("line "), F.col(line_no).cast("string"), F.lit(" doesn't fit the format: "), F.coalesce(F.col(line), F.lit("")))
    if on_error == "skip":
        return parsed.filter("is_valid").drop(*drop)
    if on_error == "abort":
        checked = parsed.withColumn("is_valid", F.when(F.col("is_valid"), F.lit(True)).otherwise(F.raise_error(said).cast("boolean")))
        return checked.filter("is_valid").drop(*drop)
    if on_error != "append" or not append_to:
        raise ValueError("on_error is abort, skip, or append with append_to")
    order = Window.partitionBy(file).orderBy(line_no)
    islands = parsed.withColumn("__entry", F.sum(F.col("is_valid").cast("long")).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    islands = islands.withColumn("__entry", F.when(F.col("__entry") > 0, F.col("__entry")).otherwise(F.raise_error(said).cast("long")))
    rest = F.sort_array(F.collect_list(F.when(~F.col("is_valid"), F.struct(F.col(line_no).alias("at"), strip(F.col(line)).alias("text")))))
    fields = [c for c in parsed.columns if c not in (file, "is_valid")]
    grouped = islands.groupBy(file, "__entry").agg(F.first(F.when(F.col("is_valid"), F.struct(*fields)), ignorenulls=True).alias("__row"), rest.alias("__rest"))
    texts = F.concat(F.array(F.col(f"__row.{append_to}")), F.transform("__rest", lambda r: r["text"]))
    keep = [c for c in fields if c not in drop]
    return grouped.select(file, *[F.array_join(texts, separator).alias(c) if c == append_to else F.col(f"__row.{c}").alias(c) for c in keep])


def rejected(lines: DataFrame, log_format: str, line: str = "line") -> DataFrame:
    """The lines that don't fit."""
    return parse(lines, log_format, line).filter("NOT is_valid").select(*lines.columns)


def non_empty(entries: DataFrame, *fields: str) -> DataFrame:
    """Entries in which all these fields hold text."""
    keep = F.lit(True)
    for f in fields:
        keep = keep & (F.coalesce(F.col(f), F.lit("")) != "")
    return entries.filter(keep)


def split_after(lines: DataFrame, markers: Sequence[str], line: str = "line", file: str = "file", line_no: str = "line_no") -> DataFrame:
    """Lines split after each match of a marker pattern, numbered anew in each file."""
    marked = F.col(line)
    for pattern in markers:
        marked = F.regexp_replace(marked, f"({pattern})", "$1\u0001")
    parts = lines.withColumn("__parts", F.split(marked, "\u0001")).select("*", F.posexplode("__parts").alias("__at", "__part")).drop("__parts")
    number = F.row_number().over(Window.partitionBy(file).orderBy(line_no, "__at"))
    return parts.withColumn(line, F.col("__part")).withColumn("__no", number.cast("long")).drop(line_no, "__part", "__at").withColumnRenamed("__no", line_no)
