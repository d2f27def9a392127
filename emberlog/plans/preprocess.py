"""The whole way from log lines to processed entries, and from a data set to event reports and training chunks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberlog.functions.patterns import PRESETS
from emberlog.operators import cleaning, events, ordering, sequences, structuring, templates
from emberlog.operators.joins import joined
from emberlog.operators.windows import LogWindows
from emberlog.sources.formats import LOG_FORMATS
from emberlog.sources.written import saved

EVENT = ("Component", "ComponentEventID")
#: Rows of instances or ids of events that are broadcast; beyond, the other side is shuffled to them.
BROADCAST_ROWS = 1_000_000


def process_logs(lines: DataFrame, dataset: str, instances: DataFrame | None = None, name: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Entries and event types. lines: instance, file, line_no, line.

    Structures lines (for hadoop, lines that don't fit are joined to the entry before them, else left out), cleans columns,
    orders the files of an instance by time, mines templates by component and rebuilds messages with simplified parameters.
    """
    fmt = "android" if dataset == "telcoapp" else dataset
    settings = PRESETS[dataset.removeprefix("summary_")]
    if dataset == "telcoapp":
        lines = structuring.split_after(lines, ["One line match string:"])
    policy = {"on_error": "append", "append_to": "Message", "separator": " "} if dataset == "hadoop" else {"on_error": "skip"}
    keyed = lines.withColumn("__file", F.concat_ws("\u0001", "instance", "file")).drop("instance", "file")
    rows = structuring.structure(keyed, LOG_FORMATS[fmt], file="__file", **policy)
    rows = rows.withColumns({"instance": F.split("__file", "\u0001")[0], "File": F.split("__file", "\u0001")[1]}).drop("__file")
    rows = cleaning.clean(rows, dataset).filter("Message <> ''")
    if dataset in cleaning.TIME_FORMATS:
        year = None
        if dataset == "telcoapp":
            years = saved(instances.select("instance", F.year("fault_time").alias("__year")))
            rows = joined(rows, F.broadcast(years) if years.count() <= BROADCAST_ROWS else years, "instance", "left")
            year = F.col("__year")
        rows = cleaning.timestamped(rows, cleaning.TIME_FORMATS[dataset], year).drop("__year")
    else:
        rows = rows.withColumn("Timestamp", F.lit(None).cast("timestamp_ntz"))
    rows = cleaning.with_defaults(rows, Component="")
    if name:
        rows = rows.withColumn("Component", F.concat_ws(":", F.lit(name), "Component"))
    rows = ordering.merged_order(rows, "instance", ["Timestamp", "File", "line_no"])
    extra = [c for c in rows.columns if c not in ("instance", "pos", "Timestamp", "File", "Component", "Message", "line_no")]
    mined = templates.mine_templates(rows, settings, "Component", ["instance", "pos"], "Message", keep=["Timestamp", "File", *extra])
    out = templates.with_simplified_message(mined, "SimplifiedMessage").withColumn("Parameters", F.transform("parameters", lambda p: p["value"]))
    out = out.withColumnRenamed("event", "ComponentEventID")
    entries = out.select("instance", "pos", "Timestamp", "File", *EVENT, *extra, "SimplifiedMessage", "Message", "Parameters")
    return entries, out.select(*EVENT, F.col("template").alias("Template")).distinct()


def analyse(entries: DataFrame, instances: DataFrame, event_types: DataFrame, spec: LogWindows, output: str = "common-entries") -> DataFrame:
    """One of window-stats, windowed-entries, cumulated-events, common-events and common-entries."""
    spec = spec.named(ts="Timestamp", message="Message")
    windows = spec.build(entries, instances)
    if output == "windowed-entries":
        return windows
    if output == "window-stats":
        return events.window_stats(windows, spec.keys, "Timestamp")
    if output == "cumulated-events":
        return joined(event_types, events.cumulated_events(windows, EVENT), EVENT, "left_semi")
    common = events.common_events(windows, spec.keys, EVENT)
    if output == "common-events":
        return joined(event_types, common, EVENT, "left_semi")
    if output == "common-entries":
        return events.entries_of(windows, common, EVENT)
    raise ValueError(f"unknown output {output!r}")


def summary_chunks(entries: DataFrame, instances: DataFrame, spec: LogWindows, excluded: LogWindows | None = None, text: str = "SimplifiedMessage", only_common: bool = True, max_length: int = 1024, sentence_max: int = 256) -> DataFrame:
    """Training chunks: input and label tokens of each window, packed up to max_length; labels are the messages of the common
    (or all) events that the excluded windows don't hold."""
    spec = spec.named(ts="Timestamp", message="Message")
    windows = spec.build(entries, instances)
    normal = None
    if excluded is not None:
        normal = events.cumulated_events(excluded.named(ts="Timestamp", message="Message").build(entries, instances), EVENT)
    # Ids of events, written once: counting them doesn't run what is above once more.
    wanted = saved(events.summary_events(windows, spec.keys, EVENT, normal, only_common).withColumn("__label", F.lit(True)))
    words = F.slice(F.split(F.coalesce(F.col(text), F.lit("")), r"\s+"), 1, sentence_max)
    rows = joined(windows.withColumns({"__words": words, "__size": F.size(words)}), F.broadcast(wanted) if wanted.count() <= BROADCAST_ROWS else wanted, EVENT, "left")
    chunks = sequences.packed(rows, list(spec.keys), ["pos"], "__size", max_length)
    return sequences.labelled_chunks(chunks, list(spec.keys), ["pos"], "__words", F.coalesce("__label", F.lit(False)))


def pretraining_windows(rows: DataFrame, within: Sequence[str], order: Sequence[str], text: Column, size: int = 10_000, stride: int | float | None = None) -> DataFrame:
    """Windows of sentences in order: within, window and sentences (array<array<string>>)."""
    placed = sequences.sliding_windows(rows.withColumn("__words", F.split(text, r"\s+")), within, order, size, stride)
    lists = F.sort_array(F.collect_list(F.struct("place", "__words")))
    return placed.groupBy(*within, "window").agg(lists.alias("s")).select(*within, "window", F.transform("s", lambda x: x["__words"]).alias("sentences"))
