"""Shards by a two-pass external shuffle.

Pass one scatters the records into buckets that fit in memory: a seeded hash of the key alone decides a record's shard, and
one of the key, the text and the input partition its bucket, so equal texts, one source, or one key or none on a third of all
rows spread evenly. Pass two shuffles each bucket (Spark's shuffle() is a Fisher-Yates shuffle) and lays the buckets of a
shard one after the other. Each bucket is one task's partition. A table that asks for more than MAX_BUCKETS is scattered on two
levels: into waves first, which are written, and then each wave into its own buckets, MAX_BUCKETS at most.

Which shard a key gets is decided by the highest seeded hash over all shards: with one more shard, a key either stays or
goes to the new shard.

Keys may be null or repeat: such rows share a shard, as the law asks, and keep a slot each. Null text counts as no bytes; an empty table gives an
empty table. Computed columns replace input columns of the same name.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from emberlog.llm.scratch import saved

SEED = 20240229
#: A bucket's records are held in memory by one task, so many bytes of text on average; so many buckets are one shuffle's at most.
BUCKET_BYTES, MAX_BUCKETS = 24 << 20, 200_000


def shard_of(key: Column, shards: int, seed: int = SEED) -> Column:
    """0 to shards - 1; more shards move keys only into the new ones. Ties go to the lower shard."""
    scores = [F.struct(F.xxhash64(F.lit(seed), F.lit(s), key).alias("h"), F.lit(-s).alias("s")) for s in range(shards)]
    return -(F.greatest(*scores) if shards > 1 else scores[0])["s"]


def bucket_count(df: DataFrame, text: str, shards: int, bucket_bytes: int = BUCKET_BYTES) -> int:
    """Buckets for each shard, from one pass over the sizes of all rows."""
    total = df.agg(F.sum(F.octet_length(F.coalesce(F.col(text), F.lit(""))) + F.lit(64)).alias("n")).first()["n"] or 0
    return max(1, -(-total // (shards * bucket_bytes)))


def external_shuffle(df: DataFrame, shards: int = 8, key: str = "doc_id", text: str = "text", seed: int = SEED, buckets: int | None = None, bucket_bytes: int = BUCKET_BYTES, most: int = MAX_BUCKETS) -> DataFrame:
    """df with shard (int), bucket (int) and slot (long, gapless from 0 in each shard), in a random order of slots.

    buckets: for each shard; None takes it from the size of the table.
    """
    n = bucket_count(df, text, shards, bucket_bytes) if buckets is None else buckets
    clean = df.drop("shard", "bucket", "slot")
    columns = [F.col(f"`{c}`") for c in clean.columns]
    mixed = F.xxhash64(F.lit(seed + 1), F.col(key), F.xxhash64(F.col(text)), F.spark_partition_id())
    at = shard_of(F.col(key), shards, seed) * F.lit(n) + F.pmod(mixed, F.lit(n)).cast("int")
    scattered = clean.select(F.struct(*columns).alias("__row"), at.alias("__at"))
    waves = -(-shards * n // most)
    if waves > 1:
        scattered = saved(scattered.withColumn("__wave", F.col("__at") % waves), "__wave")

    def bucketed(rows: DataFrame, partitions: int) -> DataFrame:
        # Partition ids are given, so that each task has one bucket.
        return rows.withColumn("__part", (F.col("__at") / waves).cast("int")).repartitionById(partitions, "__part").groupBy("__part", "__at").agg(F.sort_array(F.collect_list("__row")).alias("__rows"))

    def started(sizes: DataFrame) -> DataFrame:
        before = Window.partitionBy("shard").orderBy("__at").rowsBetween(Window.unboundedPreceding, -1)
        return sizes.withColumn("shard", (F.col("__at") / n).cast("int")).select("__at", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__start"))

    def dealt(held: DataFrame, starts: DataFrame) -> DataFrame:
        # One start for each bucket of a wave: MAX_BUCKETS rows at most.
        return held.select("__at", F.posexplode(F.shuffle("__rows", seed)).alias("__place", "__row")).join(F.broadcast(starts), "__at")

    if waves == 1:
        held = bucketed(scattered, shards * n)
        placed = dealt(held, started(held.select("__at", F.size("__rows").alias("__n"))))
    else:
        starts = saved(started(scattered.groupBy("__at").agg(F.count("*").alias("__n"))))
        parts = [(F.col("__at") % waves) == w for w in range(waves)]
        placed = reduce(DataFrame.unionByName, [dealt(bucketed(scattered.filter(F.col("__wave") == w), -(-shards * n // waves)), starts.filter(mine)) for w, mine in enumerate(parts)])
    return placed.select("__row.*", (F.col("__at") / n).cast("int").alias("shard"), (F.col("__at") % n).cast("int").alias("bucket"), (F.col("__start") + F.col("__place")).alias("slot"))


def write_shards(shuffled: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """One folder for each shard and bucket, rows by slot; a reader that takes the buckets in order reads the shuffled order.

    Rows of a bucket come from one task, so nothing is shuffled once more."""
    shuffled.sortWithinPartitions("shard", "bucket", "slot").write.mode(mode).partitionBy("shard", "bucket").parquet(path)
