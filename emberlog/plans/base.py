"""Registration of queries and the mapping of the driver's tables onto log entries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable:
    """Registers a function under its name, with SQL for the same rows if there is any."""

    def register(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Entries in SQL: an instance for each user, events in time order.
ENTRIES_SQL = """
entries AS (SELECT user_id AS instance, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS pos, ts, event_id % 4 AS file,
  event_type AS component, event_id % 7 AS event, event_type || ' ' || props AS message, event_id FROM events)
"""


def entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """instance, pos, ts, file, component, event, message, event_id."""
    from emberlog.operators.ordering import merged_order

    rows = table(spark, sf_dir, "events").select(
        F.col("user_id").alias("instance"),
        "ts",
        (F.col("event_id") % 4).alias("file"),
        F.col("event_type").alias("component"),
        (F.col("event_id") % 7).alias("event"),
        F.concat("event_type", F.lit(" "), "props").alias("message"),
        "event_id",
    )
    return merged_order(rows, "instance", ["ts", "event_id"])
