"""Queries over streams, run to the end of what there is."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emberlog.plans.base import query
from emberlog.sources.written import reserved
from emberlog.streaming import continuation, streams


def _run(rows: DataFrame, mode: str) -> DataFrame:
    """All rows that a stream gives. They go from the tasks to a table in the shared folder, each batch's in place of those before
    it (in complete mode they hold them), so none pass through the driver. The state is kept beside it, on disk."""
    spark = rows.sparkSession
    path, name, batches = reserved(spark), "spark.sql.streaming.stateStore.providerClass", []

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/rows")
        batches.append(number)

    before = spark.conf.get(name)
    spark.conf.set(name, continuation.PROVIDER)
    try:
        running = rows.writeStream.outputMode(mode).foreachBatch(keep).option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start()
        running.awaitTermination()
    finally:
        spark.conf.set(name, before)
    return spark.read.schema(rows.schema).parquet(f"{path}/rows") if batches else spark.createDataFrame([], rows.schema)


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    kinds = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    return spark.readStream.schema(kinds).parquet(f"{sf_dir}/events.parque[t]").withColumn("ts", F.col("ts").cast("timestamp"))


@query("SELECT time_bucket(INTERVAL 6 HOUR, ts) AS start, event_type, count(*) AS n FROM events GROUP BY ALL")
def stream_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = streams.counts(_events(spark, sf_dir), "ts", "event_type", "6 hours", late="30 days")
    return _run(counted, "complete").withColumn("start", F.col("start").cast("timestamp_ntz"))


@query("""WITH g AS (SELECT user_id, ts, (ts - lag(ts) OVER w >= INTERVAL 1 HOUR) IS NOT FALSE AS f FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT user_id, ts, sum(f::INT) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM g)
SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 1 HOUR AS "end", count(*) AS n FROM s GROUP BY user_id, k""")
def stream_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _run(streams.sessions(_events(spark, sf_dir), "ts", "user_id", "1 hour", late="30 days"), "complete")
    return found.withColumns({"start": F.col("start").cast("timestamp_ntz"), "end": F.col("end").cast("timestamp_ntz")})
