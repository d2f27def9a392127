"""Cleaning of entries: ordered rewrites of columns, timestamps, defaults."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberlog.functions.patterns import PATTERNS
from emberlog.functions.text import FLAGS, rewrite, stable_hash

_IPV4_PORT = (r"((?:\d{1,3}\.){3}\d{1,3}) : (\d{1,5})", "$1:$2")

#: Fixed values: (pattern, replacement) by dataset and column, in order.
RULES: dict[str, dict[str, list[tuple[str, str]]]] = {
    "hadoop": {
        "Message": [
            (rf"({PATTERNS['hdfs_url']})\s({PATTERNS['linux_path']})", "$1$2"),
            (r"(?iUd)(thread dump.*\d+ active threads).*$", "$1"),
            (r"(MSRA-SA-\d+)(?:\.\w+)+", "$1"),
            (r"[ \t]*at\s+" + PATTERNS["java_stackentry"], ""),
            (r"[ \t]*...\s+\d+\s+more", ""),
        ],
    },
    "summary_bgl": {"Message": [_IPV4_PORT]},
    "summary_hdfs": {"Message": [_IPV4_PORT]},
    "summary_spark": {"Message": [_IPV4_PORT, (r"hdfs : //([\w.:@-]*(?:(?:/[\w.~%+-]+)+/?)?)", "hdfs://$1")]},
    "summary_zookeeper": {"Message": [_IPV4_PORT]},
    "telcoapp": {
        "Message": [
            (r"\{(.*)(?:,\s+)customField=.*$", "{$1}"),
            (r"(^(?:[\w$@<>.]*: )?)\[(?:[0-9a-fA-F]+, ?){2}[0-9a-fA-F]+\]", "$1"),
            (r"\[ (?:\w+\.java|null): \d+\]", ""),
            (r"\[(?:[^ ]+ [^ ]+ )?[DIWEF](?:/[^/ ]+)+ \d+:\d+ (?:[\w$<>.]+)?:\d+\]", ""),
            (r"\[(?:\d+/\d+\.\d+:)?(?:VERBOSE\d+|DEBUG|INFO|WARNING|ERROR|FATAL)[^\]]*:[^\]]+\(\d+\)\]", ""),
            (r"^\s*HCDN_LOG:\s+\[.*?\s+.*?\]\[T:.*?\](.*?)\s*$", "$1"),
            (r"^\s*sn:\s+.*?:\s+cpu\d+/.*?:(?:\s+\d\d/\d\d\s+.*?)?\s+\[.*?\](?:\s+\[.*?\](?:\[\d+\])?)?\s+(.*?)\s*$", "$1"),
            (r"(?<=\w)[{][^{}]*([{][^{}]*([{][^{}]*([{][^{}]*([{][^{}]*([{][^{}]*[}])?[}])?[}])?[}])?[}])?[}]", ""),
            (r"^\s*at\s+(?:[^.\s]+\.)+[^.\s]+.*$", ""),
            (r"^\s*...\s+\d+\s+more", ""),
        ],
        "Component": [
            (r"DataSrv-\d+\.\d+\.\d+\.\d+-.-\d+-\d+:\d+-", ""),
            (r"[\[_-]\d+\.\d+\.\d+\.\d+[_\]-]", "."),
            (r"-\d+\.\d+\.\d+\.\d+$", ""),
            (r"^[0-9a-fA-F]+/", ""),
            (r"^-", ""),
            (r"[@:]\d{4,}]", "]"),
            (r"\.?gameplugin\d?\.P\d+", "gameplugin"),
            (r"^APwFeedback\d+$", "APwFeedback"),
            (r"^iconnect:(.*)machine.*$", "iconnect:$1machine"),
            (r"^Net\.\d+.*$", "NetworkSpeedManager"),
            (r"^ViewRootImpl\[.*\]$", "ViewRootImpl[Component]"),
            (r"^HiSight-\d+-SM$", "HiSight-StateMachine"),
            (r"(?iUd)^(handoff?)(?:(?:[ a-f0-9-]+)|(?:[ -]+[^a-f]))$", "$1"),
            (r"[/:#-][\d_]+$", ""),
            (r"_[a-fA-F\d]+$", ""),
            (r"\d{5,}$", ""),
        ],
    },
}
#: Matches in which ' : ' loses its spaces or goes, by dataset.
JOINED = {"summary_bgl": (r"(?:[\da-fA-F]{2} : ){11}[\da-fA-F]{2}", ""), "summary_proxifier": (r"\b\d{2} : \d{2}(?: : \d{2})*\b", ":")}
#: Time formats by dataset.
TIME_FORMATS = {"hadoop": "yyyy-MM-dd HH:mm:ss,SSS", "telcoapp": "MM-dd HH:mm:ss.SSS"}


def joined(c: Column, pattern: str, between: str) -> Column:
    """c with ' : ' replaced inside all matches of pattern."""
    pieces = F.split(c, FLAGS + pattern, -1)
    found = F.concat(F.transform(F.regexp_extract_all(c, F.lit(FLAGS + pattern), F.lit(0)), lambda m: F.replace(m, F.lit(" : "), F.lit(between))), F.array(F.lit("")))
    return F.array_join(F.zip_with(pieces, found, lambda p, m: F.concat(p, m)), "")


def short_package(c: Column) -> Column:
    """'org.apache.hadoop.Client' to '#', five hex digits of its package, and 'hadoop.Client'."""
    package = F.regexp_extract(c, r"(?U)^(?:[\w$]+\.)+", 0)
    last = F.regexp_extract(c, r"(?U)^([\w$]+\.)+", 1)
    code = F.lpad(F.lower(F.hex(stable_hash(package, 0x100000))), 5, "0")
    return F.when(package != "", F.concat(F.lit("#"), code, F.lit("."), last, F.substr(c, F.length(package) + 1))).otherwise(c)


def clean(entries: DataFrame, dataset: str) -> DataFrame:
    """entries with the dataset's rules applied to its columns."""
    for column, rules in RULES.get(dataset, {}).items():
        if column in entries.columns:
            entries = entries.withColumn(column, rewrite(F.col(column), rules))
    if dataset in JOINED and "Message" in entries.columns:
        entries = entries.withColumn("Message", joined(F.col("Message"), *JOINED[dataset]))
    if dataset == "hadoop" and "Component" in entries.columns:
        entries = entries.withColumn("Component", short_package(F.col("Component")))
    return entries


def timestamped(entries: DataFrame, time_format: str, year: Column | None = None, date: str = "Date", time: str = "Time") -> DataFrame:
    """Date and Time as one Timestamp (without a zone); null if they don't parse. year: for formats that lack it."""
    text = F.concat_ws(" ", F.col(date), F.col(time))
    if year is not None:
        text, time_format = F.concat_ws("-", F.lpad(year.cast("string"), 4, "0"), text), f"yyyy-{time_format}"
    return entries.withColumn("Timestamp", F.try_to_timestamp(text, F.lit(time_format)).cast("timestamp_ntz")).drop(date, time)


def with_defaults(entries: DataFrame, **defaults: str) -> DataFrame:
    """Columns that lack get the default; nulls in those that exist, too."""
    return entries.withColumns({c: F.coalesce(F.col(c), F.lit(v)) if c in entries.columns else F.lit(v) for c, v in defaults.items()})
