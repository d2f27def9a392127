"""Writers: entries, event dictionaries, data sets by instance, text blocks, statistics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberlog.operators.joins import joined


def write_entries(entries: DataFrame, path: str, form: str = "parquet", mode: str = "errorifexists") -> None:
    """CSV has its header and quotes; arrays become JSON there. An empty table gives an empty one."""
    if form == "csv":
        nested = {c: F.to_json(c) for c, t in entries.dtypes if t.startswith(("array", "map", "struct"))}
        entries.withColumns(nested).write.mode(mode).csv(path, header=True, escape='"')
    else:
        entries.write.mode(mode).format(form).save(path)


def write_mined(mined: DataFrame, path: str, templates: str | None = None, component: str = "component", form: str = "parquet", mode: str = "errorifexists") -> None:
    """Rows with their event, parameters and template; with a path for templates, rows have the event alone and each template stands
    there once, by component and event."""
    if templates is None:
        write_entries(mined, path, form, mode)
        return
    write_entries(mined.drop("template"), path, form, mode)
    write_entries(mined.select(component, "event", "template").distinct().orderBy(component, "event"), templates, form, mode)


def write_events(event_types: DataFrame, ids: DataFrame, on: Sequence[str], path: str, form: str = "csv", mode: str = "errorifexists") -> None:
    """The event types whose ids are given."""
    write_entries(joined(event_types, ids, on, "left_semi"), path, form, mode)


def write_dataset(entries: DataFrame, event_types: DataFrame, instances: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """event_types, instances, and entries in a folder for each instance, in order inside each."""
    event_types.write.mode(mode).parquet(f"{path}/event_types")
    instances.write.mode(mode).parquet(f"{path}/instances")
    entries.repartition("instance").sortWithinPartitions("instance", "pos").write.mode(mode).partitionBy("instance").parquet(f"{path}/entries")


def block(lines: Column) -> Column:
    """The filled lines, stripped, and a blank line after them."""
    stripped = F.transform(lines, lambda x: F.regexp_replace(F.coalesce(x, F.lit("")), r"(?U)^\s+|\s+$", ""))
    return F.concat(F.array_join(F.filter(stripped, lambda x: x != ""), "\n"), F.lit("\n"))


def text_blocks(df: DataFrame, lines: str) -> DataFrame:
    """value: the lines (array<string>) of each row as a block."""
    return df.select(block(F.col(lines)).alias("value"))


def write_text_blocks(df: DataFrame, lines: str, path: str, mode: str = "errorifexists") -> None:
    text_blocks(df, lines).write.mode(mode).text(path)


def write_stats(stats: DataFrame, path: str, mode: str = "errorifexists") -> None:
    stats.write.mode(mode).json(path)
