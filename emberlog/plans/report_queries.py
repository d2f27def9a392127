"""Queries of whole reports: statistics of data sets, boxes of evaluation scores, counters of a run, trees as they are shown, stemmed gap
sentences, files written and read back, and continuation lines on a stream."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emberlog.operators import masking, sequences, structuring, traces, vocabulary
from emberlog.operators.counters import Counters
from emberlog.operators.joins import joined
from emberlog.plans import statistics, text_queries
from emberlog.plans.base import query, table
from emberlog.plans.text_queries import _RE, CHOSEN_SQL, FORMAT, LINES_SQL, SENTENCES_SQL, SPANS_SQL, TOKENS_SQL
from emberlog.sources import readers, sinks
from emberlog.sources.written import folder, saved
from emberlog.streaming import continuation


def _place(spark: SparkSession) -> str:
    """A new folder in the shared one."""
    return f"{folder(spark)}/emberlog-{uuid.uuid4().hex}"


_HEADS_SQL = f"""{TOKENS_SQL}, r AS (SELECT *, sum(n) OVER (PARTITION BY lang ORDER BY n DESC, token) AS run, sum(n) OVER (PARTITION BY lang) AS total FROM v), h AS (SELECT * FROM r WHERE run <= total * 0.9)"""


@query(f"""WITH {_HEADS_SQL}, d AS (SELECT lang, len(regexp_extract_all(lower(coalesce(text, '')), '[\\p{{L}}\\p{{N}}_]+')) AS n FROM documents)
SELECT d.lang AS dataset, count(*) AS documents, sum(n)::BIGINT AS words, round(avg(n), 4) AS mean, round(stddev_pop(n), 4) AS stdev, median(n) AS median,
  (SELECT count(*) FROM v WHERE v.lang = d.lang) AS vocabulary, (SELECT count(*) FROM h WHERE h.lang = d.lang) AS head FROM d GROUP BY d.lang""")
def dataset_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, _ = statistics.dataset_statistics(table(spark, sf_dir, "documents"), "lang", "text", split_case=False)
    return found.withColumns({"mean": F.round("mean", 4), "stdev": F.round("stdev", 4)})


@query(f"""WITH {_HEADS_SQL}, c AS (SELECT lang, count(*) AS k FROM h GROUP BY lang), b AS (SELECT x.lang AS a, y.lang AS b, count(*) AS s FROM h x JOIN h y ON x.token = y.token AND x.lang < y.lang GROUP BY ALL)
SELECT b.a, b.b, round(b.s / (p.k + q.k - b.s), 6) AS overlap FROM b JOIN c p ON p.lang = b.a JOIN c q ON q.lang = b.b""")
def dataset_overlaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, found = statistics.dataset_statistics(table(spark, sf_dir, "documents"), "lang", "text", split_case=False)
    return found.withColumn("overlap", F.round("overlap", 6))


_BOX = ("mean", "q1", "median", "q3", "min", "max", "stdev", "whisker_low", "whisker_high")


def _boxes_sql() -> str:
    scores = " UNION ALL ".join(f"SELECT 'rouge_{n}' AS metric, unnest(['precision', 'recall', 'f1']) AS part, unnest([precision, recall, f1]) AS x FROM ({text_queries._rouge_sql(n)})" for n in (1, 2))
    low, high = "q1 - 1.5 * (q3 - q1)", "q3 + 1.5 * (q3 - q1)"
    return f"""WITH s AS ({scores}), q AS (SELECT metric, part, avg(x) AS mean, quantile_cont(x, 0.25) AS q1, quantile_cont(x, 0.5) AS median, quantile_cont(x, 0.75) AS q3, min(x) AS min, max(x) AS max, stddev_pop(x) AS stdev FROM s GROUP BY ALL)
SELECT q.metric, q.part, round(mean, 4) AS mean, round(q1, 4) AS q1, round(median, 4) AS median, round(q3, 4) AS q3, round(min, 4) AS min, round(max, 4) AS max, round(stdev, 4) AS stdev,
  round(min(x) FILTER (x BETWEEN {low} AND {high}), 4) AS whisker_low, round(max(x) FILTER (x BETWEEN {low} AND {high}), 4) AS whisker_high, count(*) FILTER (x < {low}) AS outliers_low, count(*) FILTER (x > {high}) AS outliers_high
FROM q JOIN s ON s.metric = q.metric AND s.part = q.part GROUP BY ALL"""


@query(_boxes_sql())
def evaluation_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = ("precision", "recall", "f1")
    listed = F.explode(F.array(*(F.struct(F.lit(p).alias("part"), F.col(p).alias("x")) for p in parts))).alias("s")
    scores = [text_queries._rouge(spark, sf_dir, n).select(F.lit(f"rouge_{n}").alias("metric"), listed).select("metric", "s.*") for n in (1, 2)]
    boxes = vocabulary.box_stats(scores[0].unionByName(scores[1]), "x", ["metric", "part"])
    return boxes.withColumns({c: F.round(c, 4) for c in _BOX})


@query(f"""WITH {LINES_SQL}, k AS (SELECT file, line_no, regexp_matches(line, '{_RE}') AS ok FROM lines)
SELECT 'structured' AS place, unnest(['read', 'kept', 'rejected']) AS counter, unnest([count(*), count(*) FILTER (ok), count(*) FILTER (NOT ok)]) AS n FROM k
UNION ALL SELECT 'packed', unnest(['rows', 'chunks']), unnest([count(*), count(*) FILTER (place % 10 = 0)]) FROM (SELECT row_number() OVER (PARTITION BY file ORDER BY line_no) - 1 AS place FROM k WHERE ok)""")
def run_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    counters = Counters()
    parsed = structuring.parse(text_queries.lines(spark, sf_dir), FORMAT)
    ok = F.col("is_valid")
    watched = counters.watch(parsed, "structured", read=F.lit(1), kept=ok, rejected=~ok)
    # Packing samples its rows to deal them by ranges, so it reads a table.
    kept = saved(watched.filter("is_valid").select("file", "line_no", F.lit(1).alias("size")))
    chunks = sequences.packed(kept, ["file"], ["line_no"], "size", 10)
    # Each line counts one, so chunks have ten.
    first = chunks.groupBy("file", "chunk").agg(F.count("*").alias("rows"))
    counters.watch(first, "packed", rows=F.col("rows"), chunks=F.lit(1)).write.format("noop").mode("overwrite").save()
    return counters.table(spark)


@query(f"""WITH RECURSIVE {SPANS_SQL}, f AS (SELECT trace, span, 0::BIGINT AS depth, CASE WHEN span = 'root' THEN span ELSE lpad(span, 20, '0') END AS path FROM spans WHERE parent IS NULL UNION ALL
SELECT s.trace, s.span, f.depth + 1, f.path || chr(1) || lpad(s.span, 20, '0') FROM f JOIN spans s ON s.trace = f.trace AND s.parent = f.span)
SELECT trace, span, depth, row_number() OVER (PARTITION BY trace ORDER BY path) - 1 AS row FROM f""")
def trace_tree_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return traces.in_tree_order(traces.forest(text_queries._tuples(spark, sf_dir)))


_STEM_SQL = f"regexp_replace(lower(x), '^(.{{3,}}?)(?:{'|'.join(text_queries.metrics.ENDINGS)})$', '\\1')"


@query(f"""WITH {SENTENCES_SQL}, z AS (SELECT doc_id, idx, list_transform(words, lambda x: {_STEM_SQL}) AS words FROM s), c AS (SELECT doc_id, idx, w, count(*) AS c FROM (SELECT doc_id, idx, unnest(words) AS w FROM z) GROUP BY ALL),
a AS (SELECT *, sum(c) OVER (PARTITION BY doc_id, w) - c AS r FROM c), o AS (SELECT doc_id, idx, sum(least(c, r)) AS o FROM a GROUP BY ALL),
f AS (SELECT z.doc_id, z.idx, round(CASE WHEN coalesce(o, 0) > 0 THEN 2 * o / sum(len(words)) OVER (PARTITION BY z.doc_id) ELSE 0 END, 6) AS score FROM z LEFT JOIN o ON o.doc_id = z.doc_id AND o.idx = z.idx)
SELECT doc_id, idx, score, {CHOSEN_SQL} AS chosen FROM f""")
def gap_sentences_stemmed(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores = masking.document_scores(text_queries._documents(spark, sf_dir), "doc_id", "sentences", "idx", stems=True)
    return masking.chosen_by_score(scores.withColumn("score", F.round("score", 6)), "doc_id", "idx", 0.3)


@query("SELECT doc_id % 7 || '.log' AS file, count(*) AS n, sum(doc_id)::BIGINT AS total FROM documents GROUP BY ALL")
def lines_read_back(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids written as text files of many rows, and read with numbers of lines that fit the order in the file."""
    path = _place(spark)
    ids = table(spark, sf_dir, "documents").select((F.col("doc_id") % 7).alias("part"), F.col("doc_id").cast("string").alias("value"))
    ids.repartition("part").sortWithinPartitions("part", F.col("value").cast("long")).write.partitionBy("part").text(path)
    rows = readers.read_lines(spark, path, recursive=True)
    part = F.regexp_extract("path", r"part=(\d+)", 1)
    # Files are written in the order of ids, so a line's number is the rank of its id.
    ranked = rows.select(part.alias("part"), "line_no", F.col("line").cast("long").alias("id"))
    ahead = joined(ranked, ranked.select("part", (F.col("line_no") + 1).alias("line_no"), F.col("id").alias("before")), ["part", "line_no"], "left")
    checked = ahead.filter((F.col("before").isNull() & (F.col("line_no") == 1)) | (F.col("before") <= F.col("id")))
    return checked.groupBy(F.concat("part", F.lit(".log")).alias("file")).agg(F.count("*").alias("n"), F.sum("id").alias("total"))


@query("SELECT c_custkey::VARCHAR AS c_custkey, c_name, c_mktsegment, 'customers' AS instance FROM customer")
def csv_read_back(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _place(spark)
    sinks.write_entries(table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_mktsegment"), path, "csv")
    return readers.read_csv_entries(spark, path).withColumn("instance", F.lit("customers"))


@query("SELECT 'c' || (o_custkey % 40) AS instance, count(*) AS n, min(o_orderkey) AS first, count(DISTINCT o_orderpriority) AS kinds FROM orders GROUP BY ALL")
def dataset_read_back(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A data set written by instance, and read with its event types."""
    path = _place(spark)
    instance = F.concat(F.lit("c"), (F.col("o_custkey") % 40).cast("string")).alias("instance")
    entries = table(spark, sf_dir, "orders").select(instance, F.col("o_orderkey").alias("pos"), F.col("o_orderpriority").alias("event"))
    sinks.write_dataset(entries, entries.select("event").distinct(), entries.select("instance").distinct(), path)
    back, kinds = spark.read.parquet(f"{path}/entries"), spark.read.parquet(f"{path}/event_types")
    return joined(back, kinds, "event", "left_semi").groupBy("instance").agg(F.count("*").alias("n"), F.min("pos").alias("first"), F.countDistinct("event").alias("kinds"))


STREAM_FORMAT = "<Level|INFO>: <Message>"
_PLAIN = "[^a-zA-Z0-9 ]"


@query(f"""WITH l AS (SELECT doc_id::VARCHAR AS file, i AS line_no, trim(regexp_replace(x, '{_PLAIN}', '', 'g')) AS line FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS x, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents))
SELECT file, min(line_no) AS line_no, 'INFO' AS "Level", string_agg(line, chr(10) ORDER BY line_no) AS "Message" FROM l GROUP BY file, (line_no - 1) // 3""")
def stream_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of documents as a stream of log lines; two of three go on with the entry before them."""
    kinds = spark.read.parquet(f"{sf_dir}/documents.parquet").schema
    docs = spark.readStream.schema(kinds).option("maxFilesPerTrigger", 4).parquet(f"{sf_dir}/documents.parque[t]")
    rows = docs.select(F.col("doc_id").cast("string").alias("file"), F.posexplode(F.split("text", "\n")).alias("at", "text")).withColumn("text", F.regexp_replace("text", _PLAIN, ""))
    line = F.when(F.col("at") % 3 == 0, F.concat(F.lit("INFO: "), "text")).otherwise(F.concat(F.lit("  "), "text"))
    lines = rows.select("file", (F.col("at") + 1).cast("long").alias("line_no"), line.alias("line"))
    path, name = _place(spark), "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, continuation.PROVIDER)
    try:
        closed = continuation.appended_stream(lines, STREAM_FORMAT, "Message")
        running = closed.writeStream.format("parquet").option("path", f"{path}/entries").option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start()
        running.awaitTermination()
    finally:
        spark.conf.set(name, before)
    return spark.read.schema(closed.schema).parquet(f"{path}/entries").unionByName(continuation.open_entries(spark, f"{path}/state", STREAM_FORMAT, "Message"))
