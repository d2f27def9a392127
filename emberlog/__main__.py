"""python -m emberlog: formats, structure, abstract, preprocess, analyse and statistics."""

from __future__ import annotations

import argparse
import sys
from functools import reduce

from pyspark.sql import functions as F


def _parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="emberlog", description=__doc__)
    sub = top.add_subparsers(dest="command", required=True)
    p = sub.add_parser("formats", help="list format presets, or show what one compiles to")
    p.add_argument("format", nargs="?")
    sub.add_parser("presets", help="list mining presets")
    p = sub.add_parser("structure", help="lines to entries")
    p.add_argument("format")
    p.add_argument("source")
    p.add_argument("destination")
    p.add_argument("-n", "--non-empty", action="append", default=[], help="leave out entries with nothing in this field")
    p.add_argument("-e", "--on-error", default="abort", help="abort, skip, or :field[:separator] to append to the entry before")
    p.add_argument("--line-number", help="a column for line numbers")
    p.add_argument("--form", default="csv", choices=["csv", "parquet"])
    p = sub.add_parser("abstract", help="messages to event ids, templates and parameters")
    p.add_argument("column", help="a name, or a number for files without a header")
    p.add_argument("source", help="a CSV file, or - for standard input")
    p.add_argument("destination")
    p.add_argument("-p", "--preset", default="hadoop")
    p.add_argument("--similarity", type=float)
    p.add_argument("--depth", type=int)
    p.add_argument("--templates", help="write each template once, to this place, and rows without")
    p.add_argument("--form", default="parquet", choices=["csv", "parquet"])
    p = sub.add_parser("statistics", help="lengths, vocabularies and overlaps of data sets")
    p.add_argument("column", help="the text column")
    p.add_argument("destination")
    p.add_argument("datasets", nargs="+", help="name=path of CSV files")
    p.add_argument("--percentile", type=float, default=0.9)
    p.add_argument("--min-frequency", type=int)
    p = sub.add_parser("preprocess", help="log files to a data set")
    p.add_argument("dataset", help="hadoop, telcoapp or a summary_ preset")
    p.add_argument("source")
    p.add_argument("destination")
    p.add_argument("-f", "--force", action="store_true")
    p = sub.add_parser("analyse", help="windows and events of a data set")
    p.add_argument("source")
    p.add_argument("destination")
    p.add_argument("--config", help="a JSON file of window options")
    p.add_argument("--output-type", default="common-entries", choices=["window-stats", "windowed-entries", "cumulated-events", "common-events", "common-entries"])
    return top


def main(arguments: list[str] | None = None) -> int:
    from emberlog.functions.patterns import PRESETS, MiningSettings
    from emberlog.operators import structuring, templates, vocabulary
    from emberlog.operators.windows import LogWindows
    from emberlog.plans import preprocess, statistics
    from emberlog.session import get_session
    from emberlog.sources import formats, readers, sinks

    o = _parser().parse_args(arguments)
    if o.command == "formats":
        if o.format:
            compiled = formats.compile_format(o.format)
            print(",".join(compiled.fields), compiled.pattern, sep="\n")
        else:
            print(*(f"{name:>18}: {text}" for name, text in formats.LOG_FORMATS.items()), sep="\n")
        return 0
    if o.command == "presets":
        print(*(f"{name:>12}: similarity {p.similarity}, depth {p.depth}, masks {', '.join(n for n, _ in p.masks) or '-'}" for name, p in PRESETS.items()), sep="\n")
        return 0
    spark = get_session()
    if o.command == "structure":
        policy = {"on_error": o.on_error}
        if o.on_error.startswith(":"):
            name, _, separator = o.on_error[1:].partition(":")
            policy = {"on_error": "append", "append_to": name, "separator": separator or "\n"}
        rows = structuring.structure(readers.read_lines(spark, o.source), o.format, file="path", **policy)
        rows = structuring.non_empty(rows, *o.non_empty) if o.non_empty else rows
        rows = rows.drop("path", "file")
        sinks.write_entries(rows.withColumnRenamed("line_no", o.line_number) if o.line_number else rows.drop("line_no"), o.destination, o.form)
    elif o.command == "abstract":
        column = int(o.column) if o.column.isdigit() else o.column
        base = PRESETS[o.preset]
        settings = MiningSettings(o.similarity or base.similarity, o.depth or base.depth, base.masks)
        source = readers.from_standard_input(spark) if o.source == "-" else o.source
        rows = readers.csv_column(spark, source, column).select(F.lit("").alias("component"), F.monotonically_increasing_id().alias("pos"), F.col("value").alias("message"))
        mined = templates.with_simplified_message(templates.mine_templates(rows, settings))
        if o.templates:
            sinks.write_mined(mined, o.destination, o.templates, form=o.form)
        else:
            sinks.write_entries(mined.drop("component"), o.destination, o.form)
    elif o.command == "statistics":
        parts = [readers.csv_column(spark, path, o.column).select(F.lit(name).alias("dataset"), F.col("value").alias("text")) for name, _, path in (d.partition("=") for d in o.datasets)]
        lengths, overlaps = statistics.dataset_statistics(reduce(lambda a, b: a.unionByName(b), parts), "dataset", "text", o.percentile, o.min_frequency, vocabulary.STOP_WORDS)
        sinks.write_stats(lengths, f"{o.destination}/datasets")
        sinks.write_stats(overlaps, f"{o.destination}/overlaps")
    elif o.command == "preprocess":
        lines = readers.read_lines(spark, o.source, "*.log" if o.dataset == "hadoop" else None, recursive=True)
        if o.dataset.startswith("summary_"):
            instances, logs = readers.summary_file(lines, o.dataset.removeprefix("summary_"))
            logs = logs.withColumn("file", F.col("instance"))
        elif o.dataset == "hadoop":
            logs = readers.discovered(lines, "hadoop")
            instances = readers.label_file(readers.read_lines(spark, f"{o.source}/abnormal_label.txt"))
        else:
            instances, logs = readers.diagnosed_instances(lines, o.source)
        entries, kinds = preprocess.process_logs(logs.select("instance", "file", "line_no", "line"), o.dataset, instances)
        sinks.write_dataset(entries, kinds, instances, o.destination, "overwrite" if o.force else "errorifexists")
    else:
        spec = LogWindows.from_options(readers.load_options(o.config)) if o.config else LogWindows()
        entries, kinds, instances = (spark.read.parquet(f"{o.source}/{n}") for n in ("entries", "event_types", "instances"))
        sinks.write_entries(preprocess.analyse(entries, instances, kinds, spec, o.output_type), o.destination)
    return 0


if __name__ == "__main__":
    sys.exit(main())
