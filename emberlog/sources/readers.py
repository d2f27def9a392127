"""Readers: log lines, CSV entries, instance metadata, label, summary and diagnosis files, traces, configs."""

from __future__ import annotations

import json
import re
import sys
import uuid
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from emberlog.functions.text import strip
from emberlog.operators import traces
from emberlog.sources.written import folder, saved

#: Splits of text files whose line counts are broadcast.
MOST_SPLITS = 200_000

INSTANCE_SCHEMA = "map<string, struct<category: array<string>, summary: array<string>, fault_time: string, analysis: string>>"


def read_lines(spark: SparkSession, path: str | Sequence[str], pattern: str | None = None, recursive: bool = False) -> DataFrame:
    """path, file (its name), line_no (from 1 in each file) and line; bytes that aren't UTF-8 become U+FFFD.

    A file may be read in many splits, each by a task of its own. Lines are numbered in their split, and each split gets the sum of
    the lines in the splits before it, from a first pass that only counts. One number for each split is what goes over the network:
    broadcast up to MOST_SPLITS, joined beyond.
    """
    reader = spark.read.option("recursiveFileLookup", str(recursive).lower())
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    at = [F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("__block"), F.monotonically_increasing_id().alias("__id")]
    rows = reader.text(path).select(*at, F.make_valid_utf8("value").alias("line"))
    # A split is read by one task from its begin to its end, so its lines have ids without gaps.
    splits = rows.groupBy("path", "__block").agg(F.min("__id").alias("__first"), F.count("*").alias("__n"))
    before = F.sum("__n").over(Window.partitionBy("path").orderBy("__block").rowsBetween(Window.unboundedPreceding, -1))
    splits = saved(splits.select(F.col("path").alias("__p"), F.col("__block").alias("__b"), (F.coalesce(before, F.lit(0)) - F.col("__first") + 1).alias("__add")))
    splits = F.broadcast(splits) if splits.count() <= MOST_SPLITS else splits
    met = rows.join(splits, (F.col("path") == F.col("__p")) & (F.col("__block") == F.col("__b")))
    return met.select("path", F.element_at(F.split("path", "/"), -1).alias("file"), (F.col("__id") + F.col("__add")).alias("line_no"), "line")


def read_csv_entries(spark: SparkSession, path: str | Sequence[str], header: bool = True) -> DataFrame:
    """All columns as strings, with the file's name without its ending as instance."""
    rows = spark.read.csv(path, header=header, multiLine=True, escape='"', inferSchema=False)
    return rows.withColumn("instance", F.regexp_replace(F.element_at(F.split(F.input_file_name(), "/"), -1), r"\.csv$", ""))


def csv_column(spark: SparkSession, path: str, column: int | str) -> DataFrame:
    """One column as 'value': by place, in a file without a header, or by name."""
    rows = spark.read.csv(path, header=isinstance(column, str), multiLine=True, escape='"')
    return rows.select((F.col(f"`{column}`") if isinstance(column, str) else F.col(rows.columns[column])).alias("value"))


def read_instances(spark: SparkSession, path: str) -> DataFrame:
    """instance, category, summary, fault_time (timestamp without a zone) and analysis from one JSON object."""
    whole = spark.read.text(path, wholetext=True).select(F.from_json("value", INSTANCE_SCHEMA).alias("m"))
    rows = whole.select(F.explode("m").alias("instance", "p")).select("instance", "p.*")
    return rows.withColumn("fault_time", F.try_to_timestamp("fault_time").cast("timestamp_ntz"))


def label_file(lines: DataFrame) -> DataFrame:
    """instance and category from '### application', 'type:' and '+ instance' lines (file, line_no, line)."""
    text = strip(F.col("line"))
    before = Window.partitionBy("file").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    app = F.when(text.startswith("###"), strip(F.substr(text, F.lit(4))))
    kind = F.when(text.endswith(":") & ~text.startswith("###"), strip(F.regexp_replace(text, ":$", "")))
    rows = lines.select(text.alias("t"), F.last(app, ignorenulls=True).over(before).alias("app"), F.last(kind, ignorenulls=True).over(before).alias("kind"))
    found = rows.filter(F.col("t").startswith("+ ") & F.col("app").isNotNull() & F.col("kind").isNotNull())
    return found.select(strip(F.substr("t", F.lit(3))).alias("instance"), F.array("kind", "app").alias("category"))


def summary_file(lines: DataFrame, kind: str) -> tuple[DataFrame, DataFrame]:
    """Instances (instance, category, summary) and their log lines (instance, line_no, line).

    A line that starts with '#' opens a block; '#summary:#' says that the next line is its summary, split at ';'.
    """
    text = strip(F.col("line"))
    full = lines.select("file", "line_no", text.alias("line")).filter("line <> ''")
    w = Window.partitionBy("file").orderBy("line_no")
    told = full.withColumn("__summary", F.coalesce(F.lag("line").over(w) == "#summary:#", F.lit(False)) & ~F.col("line").startswith("#"))
    done = F.sum(F.col("__summary").cast("long")).over(w.rowsBetween(Window.unboundedPreceding, -1))
    numbered = told.withColumn("instance", F.concat(F.lit(f"{kind}_"), F.coalesce(done, F.lit(0)).cast("string")))
    pieces = F.transform(F.split(F.regexp_replace("line", "^;+|;+$", ""), ";"), strip)
    instances = numbered.filter("__summary").select("instance", F.array(F.lit(f"summary_{kind}")).alias("category"), pieces.alias("summary"))
    logs = numbered.filter(~F.col("__summary") & ~F.col("line").startswith("#")).select("instance", "line_no", "line")
    return instances, logs.join(instances.select("instance"), "instance", "left_semi")


def diagnosis_file(lines: DataFrame) -> DataFrame:
    """file, fault_time (the last 'Fault time:' or the first line; null if it doesn't parse) and analysis (the last root cause)."""
    w = Window.partitionBy("file").orderBy("line_no")
    rows = lines.select("file", "line_no", strip(F.col("line")).alias("t")).filter("t <> ''").withColumns({"next": F.lead("t").over(w)})
    after = lambda name: F.when(F.lower("t").startswith(name), strip(F.substr("t", F.lit(len(name) + 1))))
    cause = after("root cause:")
    rows = rows.withColumns({"fault": after("fault time:"), "cause": F.nullif(F.when(cause == "", F.col("next")).otherwise(cause), F.lit(""))})
    last = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), F.col("line_no")))
    out = rows.groupBy("file").agg(last("fault").alias("fault"), F.min_by("t", "line_no").alias("first"), last("cause").alias("analysis"))
    return out.select("file", F.try_to_timestamp(F.coalesce("fault", "first"), F.lit("yyyy-MM-dd HH:mm:ss")).cast("timestamp_ntz").alias("fault_time"), "analysis")


def discovered(lines: DataFrame, layout: str) -> DataFrame:
    """Adds instance from the path: 'hadoop' takes the folder; 'telcoapp' the digits of the anomaly, the cause and the number."""
    part = lambda k: F.element_at(F.split("path", "/"), -k)
    if layout == "hadoop":
        return lines.withColumn("instance", part(2))
    number = F.when(part(2).rlike(r"^\d+$"), part(2)).otherwise(F.lit("1"))
    return lines.withColumn("instance", F.concat_ws("_", F.regexp_extract(part(4), r"\d+", 0), part(3), number))


def diagnosed_instances(lines: DataFrame, root: str) -> tuple[DataFrame, DataFrame]:
    """Instances (instance, category, fault_time, analysis) and log lines with their instance, of files below root: anomaly, cause and
    number are the first three folders (a third one that is no number counts as 1); logs are files whose name begins with
    hiapplogcat. A diagnosis file (rd.txt, in any case) stands two folders above a log's own; where it names no cause, that of
    the folder above counts. Of several logs of an instance that of the last path decides.
    """
    inner = F.regexp_replace("path", "^.*?" + re.escape(root.split(":", 1)[-1].strip("/")) + "/", "")
    part = lambda k: F.get(F.split(inner, "/"), F.lit(k))
    up = lambda c, n: F.regexp_replace(c, f"(?:/[^/]*){{{n}}}$", "")
    number = F.when(part(2).rlike(r"^\d+$"), part(2)).otherwise(F.lit("1"))
    logs = lines.filter(F.col("file").startswith("hiapplogcat")).withColumn("instance", F.concat_ws("_", F.regexp_extract(part(0), r"\d+", 0), part(1), number))
    told = diagnosis_file(lines.filter(F.lower("file") == "rd.txt").withColumn("file", up(F.col("path"), 1)))
    last = logs.select("instance", "path", F.array(part(0), part(1)).alias("category")).groupBy("instance").agg(F.max_by("category", "path").alias("category"), F.max("path").alias("path"))
    last = last.withColumns({"__near": up(F.col("path"), 3), "__far": up(F.col("path"), 4)})
    near = told.select(F.col("file").alias("__near"), "fault_time", F.col("analysis").alias("__own"))
    far = told.select(F.col("file").alias("__far"), F.col("analysis").alias("__above"))
    out = last.join(near, "__near", "left").join(far, "__far", "left")
    return out.select("instance", "category", "fault_time", F.coalesce("__own", "__above").alias("analysis")), logs


def from_standard_input(spark: SparkSession, suffix: str = ".csv") -> str:
    """Standard input as a file in the shared folder; it goes through in pieces."""
    path = f"{folder(spark)}/emberlog-{uuid.uuid4().hex}{suffix}"
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = at.getFileSystem(spark._jsc.hadoopConfiguration()).create(at)
    try:
        while piece := sys.stdin.buffer.read(1 << 20):
            out.write(piece)
    finally:
        out.close()
    return path


def trace_tuples_from_csv(spark: SparkSession, files: Sequence[dict]) -> DataFrame:
    """Trace tuples of several files in order. Each: path, and message (markers) or trace, parent and span columns."""
    parts: list[DataFrame] = []
    for i, f in enumerate(files):
        rows = spark.read.csv(f["path"], header=True, multiLine=True, escape='"').withColumn("__id", F.monotonically_increasing_id())
        rows = traces.from_markers(rows, f["message"]) if "message" in f else traces.from_columns(rows, f["trace"], f["parent"], f["span"])
        parts.append(rows.withColumn("pos", F.struct(F.lit(i).alias("file"), F.col("__id").alias("row"))).drop("__id"))
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def load_options(path: str) -> dict:
    """Options of a JSON config: an object, or a list of [name] and [name, value]. Files with code aren't run."""
    with open(path) as f:
        found = json.load(f)
    items = found.items() if isinstance(found, dict) else found
    return {item[0]: item[1] if len(item) == 2 else True for item in items}


def as_arguments(options: dict) -> list[str]:
    """Options as a command line: lists give several arguments, a flag its name alone."""
    out = []
    for name, value in options.items():
        out.append(f"--{name}")
        out.extend([] if value is True else map(str, value) if isinstance(value, (list, tuple)) else [str(value)])
    return out


