"""The whole way from lines to entries, windows, events and chunks, on log lines made of events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from emberlog.operators.windows import LogWindows
from emberlog.plans import preprocess
from emberlog.plans.base import query, table

SPEC = LogWindows(partition_patterns=("error",), minimum_size=20)
CHUNK_WORDS = 30

#: Entries as process_logs() gives them, and the windows of SPEC.
FLOW_SQL = """e AS (SELECT user_id, event_id, (event_id % 4)::VARCHAR AS file, date_trunc('milliseconds', ts) AS ts, event_type,
  row_number() OVER (PARTITION BY user_id, event_id % 4 ORDER BY ts, event_id) AS line_no FROM events),
entries AS (SELECT user_id::VARCHAR AS instance, row_number() OVER (PARTITION BY user_id ORDER BY ts, file, line_no) AS pos, ts, file,
  '#' || lpad(printf('%x', ('0x' || substr(md5('org.shop.' || event_type || '.'), 1, 8))::BIGINT % 1048576), 5, '0') || '.' || event_type || '.Worker' AS component,
  event_type || ' took=' || (event_id % 90) AS message FROM e),
parts AS (SELECT *, sum((message LIKE '%error%')::INT) OVER (PARTITION BY instance ORDER BY pos)::BIGINT AS partition_id FROM entries),
windowed AS (SELECT * FROM (SELECT *, count(*) OVER (PARTITION BY instance, partition_id) AS n FROM parts) WHERE n >= 20),
pairs AS (SELECT DISTINCT instance, partition_id, component FROM windowed),
common AS (SELECT component FROM pairs GROUP BY ALL HAVING count(*) = (SELECT count(*) FROM (SELECT DISTINCT instance, partition_id FROM windowed)))"""


def raw_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """instance, file, line_no, line: a line for each event, and a line of a stack after every fifth."""
    order = Window.partitionBy("user_id", "file").orderBy("ts", "event_id")
    rows = table(spark, sf_dir, "events").withColumn("file", (F.col("event_id") % 4).cast("string")).withColumn("n", F.row_number().over(order))
    head = F.concat(F.date_format("ts", "yyyy-MM-dd HH:mm:ss,SSS"), F.lit(" INFO [main] org.shop."), "event_type", F.lit(".Worker: "), "event_type", F.lit(" took="), (F.col("event_id") % 90).cast("string"))
    stack = F.when(F.col("event_id") % 5 == 0, F.lit("    at org.shop.Worker.run(Worker.java:12)"))
    return rows.select(F.col("user_id").cast("string").alias("instance"), "file", "n", F.posexplode(F.array_compact(F.array(head, stack))).alias("k", "line")).select(
        "instance", "file", (2 * F.col("n") + F.col("k")).cast("long").alias("line_no"), "line"
    )


def _entries(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    lines = raw_lines(spark, sf_dir)
    return *preprocess.process_logs(lines, "hadoop"), lines.select("instance").distinct()


@query(f"WITH {FLOW_SQL} SELECT instance, pos, ts AS \"Timestamp\", file AS \"File\", component AS \"Component\", 1::BIGINT AS \"ComponentEventID\", message AS \"SimplifiedMessage\" FROM entries")
def process_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    entries, _, _ = _entries(spark, sf_dir)
    return entries.select("instance", F.col("pos").cast("long").alias("pos"), F.col("Timestamp").cast("timestamp").alias("Timestamp"), "File", "Component", "ComponentEventID", "SimplifiedMessage")


@query(f"WITH {FLOW_SQL} SELECT DISTINCT component AS \"Component\", 1::BIGINT AS \"ComponentEventID\", regexp_replace(message, '\\d+', '<number>') AS \"Template\" FROM entries")
def process_event_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _entries(spark, sf_dir)[1]


@query(f"WITH {FLOW_SQL} SELECT w.instance, w.pos, w.partition_id, w.component AS \"Component\", w.message AS \"Message\" FROM windowed w SEMI JOIN common c ON c.component = w.component")
def analyse_common_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    entries, types, instances = _entries(spark, sf_dir)
    found = preprocess.analyse(entries, instances, types, SPEC, "common-entries")
    return found.select("instance", F.col("pos").cast("long").alias("pos"), "partition_id", "Component", "Message")


@query(f"WITH {FLOW_SQL} SELECT DISTINCT w.component AS \"Component\", 1::BIGINT AS \"ComponentEventID\", regexp_replace(w.message, '\\d+', '<number>') AS \"Template\" FROM windowed w")
def analyse_cumulated_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    entries, types, instances = _entries(spark, sf_dir)
    return preprocess.analyse(entries, instances, types, SPEC, "cumulated-events")


@query(f"""WITH {FLOW_SQL}, placed AS (SELECT w.*, (row_number() OVER (PARTITION BY w.instance, w.partition_id ORDER BY pos) - 1) // {CHUNK_WORDS // 2} AS chunk, c.component IS NOT NULL AS wanted
  FROM windowed w LEFT JOIN common c ON c.component = w.component)
SELECT instance, partition_id, chunk, 2 * count(*)::BIGINT AS n_inputs, 2 * count(*) FILTER (wanted)::BIGINT AS n_labels, md5(string_agg(message, ' ' ORDER BY pos)) AS inputs_md5,
  md5(coalesce(string_agg(message, ' ' ORDER BY pos) FILTER (wanted), '')) AS labels_md5 FROM placed GROUP BY ALL""")
def make_summary_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    entries, _, instances = _entries(spark, sf_dir)
    chunks = preprocess.summary_chunks(entries, instances, SPEC, max_length=CHUNK_WORDS)
    size, told = lambda c: F.size(c).cast("long"), lambda c: F.md5(F.array_join(c, " ").cast("binary"))
    return chunks.select("instance", "partition_id", "chunk", size("input_ids").alias("n_inputs"), size("labels").alias("n_labels"), told("input_ids").alias("inputs_md5"), told("labels").alias("labels_md5"))
