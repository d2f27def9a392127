"""Queries over log entries: filters, windows, events, orders."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emberlog.operators import events, ordering, windows
from emberlog.plans.base import ENTRIES_SQL, entries, query, table

EVENT = ["component", "event"]
HOUR = 3_600_000

#: Windows that start at each 'error', in SQL.
PARTS_SQL = f"""WITH {ENTRIES_SQL},
parts AS (SELECT *, sum((message LIKE '%error%')::INT) OVER (PARTITION BY instance ORDER BY pos)::BIGINT AS partition_id FROM entries)"""
WINDOWED_SQL = f"""{PARTS_SQL},
windowed AS (SELECT * FROM (SELECT *, count(*) OVER (PARTITION BY instance, partition_id) AS n FROM parts) WHERE n >= 20)"""


def _parts(spark: SparkSession, sf_dir: str, must_include: bool = False) -> DataFrame:
    return windows.LogWindows(partition_patterns=("error",), must_include_pattern=must_include).build(entries(spark, sf_dir))


def _windowed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.LogWindows(partition_patterns=("error",), minimum_size=20).build(entries(spark, sf_dir))


@query("SELECT doc_id, lang, source FROM documents WHERE (lang = 'en' AND source = 'src1') OR lang = 'fr'")
def category_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", F.array("lang", "source").alias("category"))
    return windows.category_filter(docs, ["en", "src1"], ["fr"]).drop("category")


@query(f"""WITH {ENTRIES_SQL}, bases AS (SELECT instance, min(ts) AS base FROM entries WHERE component = 'error' GROUP BY instance)
SELECT e.event_id, e.instance, e.pos FROM entries e JOIN bases b ON e.instance = b.instance
WHERE e.ts BETWEEN b.base - INTERVAL 6 HOUR AND b.base + INTERVAL 6 HOUR""")
def time_window_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = entries(spark, sf_dir)
    bases = rows.filter(F.col("component") == "error").groupBy("instance").agg(F.min("ts").alias("base"))
    return windows.time_filter(rows, bases, "base", windows.time_bounds(tolerance_ms=6 * HOUR)).select("event_id", "instance", "pos")


@query(f"""WITH {ENTRIES_SQL} SELECT event_id, instance, file FROM (SELECT *, count(*) OVER (PARTITION BY instance, file) AS n FROM entries) WHERE n >= 3""")
def group_min_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.LogWindows(group_by=("file",), minimum_size=3).build(entries(spark, sf_dir)).select("event_id", "instance", "file")


@query(f"{PARTS_SQL} SELECT event_id, instance, pos, partition_id FROM parts")
def pattern_partition(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _parts(spark, sf_dir).select("event_id", "instance", "pos", "partition_id")


@query(f"{PARTS_SQL} SELECT event_id, instance, pos, partition_id FROM parts WHERE partition_id > 0")
def pattern_partition_must_include(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _parts(spark, sf_dir, True).select("event_id", "instance", "pos", "partition_id")


@query(f"""WITH {ENTRIES_SQL} SELECT r.instance, a.pos AS anchor, r.pos FROM entries a JOIN entries r ON a.instance = r.instance
AND a.message LIKE '%error%' AND r.ts BETWEEN a.ts - INTERVAL 12 HOUR AND a.ts""")
def frame_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    spec = windows.LogWindows(frame_patterns=("error",), frame_bounds=(-12 * HOUR, 0))
    return spec.build(entries(spark, sf_dir)).select("instance", "anchor", "pos")


@query(f"""{PARTS_SQL} SELECT r.instance, r.partition_id, a.pos AS anchor, r.pos FROM parts a JOIN parts r ON a.instance = r.instance
AND a.partition_id = r.partition_id AND a.message LIKE '%purchase%' AND r.ts <= a.ts""")
def frame_open_ended(spark: SparkSession, sf_dir: str) -> DataFrame:
    spec = windows.LogWindows(partition_patterns=("error",), frame_patterns=("purchase",), frame_bounds=windows.time_bounds(range_ms=(None, 0)))
    return spec.build(entries(spark, sf_dir)).select("instance", "partition_id", "anchor", "pos")


@query(f"""{PARTS_SQL} SELECT instance, partition_id, count(*)::BIGINT AS n,
round((epoch_us(max_by(ts, pos)) - epoch_us(min_by(ts, pos))) / 1e6, 6) AS seconds FROM parts GROUP BY ALL""")
def window_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    stats = events.window_stats(_parts(spark, sf_dir), ["instance", "partition_id"])
    return stats.withColumn("seconds", F.round("seconds", 6))


@query(f"{WINDOWED_SQL} SELECT DISTINCT component, event FROM windowed")
def cumulated_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events.cumulated_events(_windowed(spark, sf_dir), EVENT)


COMMON_SQL = f"""{WINDOWED_SQL}, pairs AS (SELECT DISTINCT instance, partition_id, event FROM windowed),
common AS (SELECT event FROM pairs GROUP BY ALL HAVING count(*) = (SELECT count(*) FROM (SELECT DISTINCT instance, partition_id FROM windowed)))"""


@query(f"{COMMON_SQL} SELECT event FROM common")
def common_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events.common_events(_windowed(spark, sf_dir), ["instance", "partition_id"], ["event"])


@query(f"""WITH {ENTRIES_SQL}, pairs AS (SELECT DISTINCT instance, component FROM entries),
common AS (SELECT component FROM pairs GROUP BY component HAVING count(*) >= (SELECT count(DISTINCT instance) FROM entries))
SELECT event_id, instance, pos, component FROM entries SEMI JOIN common USING (component)""")
def common_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = entries(spark, sf_dir)
    return events.entries_of(rows, events.common_events(rows, ["instance"], ["component"]), ["component"]).select("event_id", "instance", "pos", "component")


@query(f"""WITH RECURSIVE {ENTRIES_SQL}, w AS (SELECT instance, list(DISTINCT event) AS s, row_number() OVER (ORDER BY instance) AS i FROM entries GROUP BY instance),
f AS (SELECT i, s FROM w WHERE i = 1 UNION ALL SELECT w.i, CASE WHEN len(f.s) = 0 THEN w.s ELSE list_filter(f.s, lambda x: list_contains(w.s, x)) END FROM f JOIN w ON w.i = f.i + 1)
SELECT unnest(s)::BIGINT AS event FROM f WHERE i = (SELECT max(i) FROM w)""")
def common_events_in_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events.common_events_in_order(entries(spark, sf_dir), ["instance"], ["instance"], ["event"])


@query(f"""{PARTS_SQL} SELECT DISTINCT component, event, file FROM parts WHERE partition_id > 0 EXCEPT SELECT component, event, file FROM parts WHERE partition_id = 0""")
def excluded_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _parts(spark, sf_dir)
    event = [*EVENT, "file"]
    normal = events.cumulated_events(rows.filter("partition_id = 0"), event)
    return events.summary_events(rows.filter("partition_id > 0"), ["instance", "partition_id"], event, normal, only_common=False)


@query("SELECT event_id, user_id, event_type FROM (SELECT *, lag(event_type) OVER w AS l, row_number() OVER w AS r FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)) WHERE r = 1 OR l <> event_type")
def consecutive_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events")
    return ordering.consecutive_distinct(rows, ["user_id"], ["ts", "event_id"], "event_type").select("event_id", "user_id", "event_type")


@query("SELECT o_custkey, o_orderkey, o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS r FROM orders) WHERE r <= 3")
def topk_per_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_totalprice")
    return ordering.top_k(rows, 3, [F.desc("o_totalprice"), "o_orderkey"], ["o_custkey"])


@query("SELECT event_id, value FROM events ORDER BY value DESC, event_id LIMIT 25")
def topk_heap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ordering.top_k(table(spark, sf_dir, "events").select("event_id", "value"), 25, [F.desc("value"), "event_id"])


@query("SELECT event_id, user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id % 4, event_id) AS pos FROM events")
def merge_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events")
    return ordering.merged_order(rows, "user_id", ["ts", F.col("event_id") % 4, "event_id"]).select("event_id", "user_id", "pos")


@query("""SELECT doc_id, source FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS r FROM documents)
WHERE source <> 'src0' AND r <= CASE WHEN source = 'src1' THEN 5 ELSE 12 END""")
def limit_by_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source")
    return ordering.limit_by_source(docs, {"src0": 0, "src1": 5}, 12, "source", ["doc_id"])


@query("""SELECT event_id, event_type FROM events WHERE event_id NOT IN (SELECT event_id FROM events WHERE event_type = 'error') AND event_type IN
(SELECT event_type FROM events WHERE value > 80 INTERSECT SELECT event_type FROM events WHERE value < 20)""")
def id_set_operations(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events")
    kinds = rows.filter("value > 80").select("event_type").intersect(rows.filter("value < 20").select("event_type"))
    return rows.join(kinds, "event_type", "left_semi").join(rows.filter("event_type = 'error'").select("event_id"), "event_id", "left_anti").select("event_id", "event_type")
