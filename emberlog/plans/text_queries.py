"""Queries over lines, templates, sentences, traces and metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from emberlog.functions.patterns import PATTERNS, MiningSettings, masks
from emberlog.functions.text import natural_key, stable_hash
from emberlog.operators import cleaning, masking, metrics, sequences, structuring, templates, traces, vocabulary
from emberlog.operators.windows import LogWindows
from emberlog.plans.base import entries, query, table
from emberlog.sources import sinks

#: Log lines made of events, in SQL and as columns; every fifth line doesn't fit the format.
GOOD_SQL = "strftime(ts, '%Y-%m-%d %H:%M:%S') || ' INFO [' || (event_id % 4) || '] ' || event_type || ': took ' || value || ' ms ' || props"
LINES_SQL = f"""lines AS (SELECT user_id AS file, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS line_no, event_id,
  CASE WHEN event_id % 5 = 0 AND event_id > 200 THEN '  at frame ' || event_id ELSE {GOOD_SQL} END AS line
  FROM events)"""
FORMAT = r"<Date> <Time> <Level> \[<Process>\] <Component>: <Message>"
_RE = r"^\s*(.*?)\s+(.*?)\s+(.*?)\s+\[(.*?)\]\s+(.*?):\s+(.*?)\s*$"
FIELDS_SQL = ", ".join(f"trim(regexp_extract(line, '{_RE}', {i + 1})) AS \"{n}\"" for i, n in enumerate(("Date", "Time", "Level", "Process", "Component", "Message")))


def lines(spark: SparkSession, sf_dir: str, broken: bool = True) -> DataFrame:
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    good = F.concat(F.date_format("ts", "yyyy-MM-dd HH:mm:ss"), F.lit(" INFO ["), (F.col("event_id") % 4).cast("string"), F.lit("] "), "event_type", F.lit(": took "), F.col("value").cast("string"), F.lit(" ms "), "props")
    bad = F.concat(F.lit("  at frame "), F.col("event_id").cast("string"))
    return table(spark, sf_dir, "events").select(
        F.col("user_id").alias("file"),
        F.row_number().over(order).cast("long").alias("line_no"),
        "event_id",
        F.when((F.col("event_id") % 5 == 0) & (F.col("event_id") > 200) & F.lit(broken), bad).otherwise(good).alias("line"),
    )


@query(f"SELECT event_id, file, line_no, {FIELDS_SQL} FROM (SELECT user_id AS file, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS line_no, event_id, {GOOD_SQL} AS line FROM events)")
def structure_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return structuring.structure(lines(spark, sf_dir, broken=False), FORMAT)


@query(f"WITH {LINES_SQL} SELECT event_id, file, line_no, {FIELDS_SQL} FROM lines WHERE regexp_matches(line, '{_RE}')")
def structure_skip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return structuring.structure(lines(spark, sf_dir), FORMAT, "skip")


@query(f"WITH {LINES_SQL} SELECT event_id, line FROM lines WHERE NOT regexp_matches(line, '{_RE}')")
def structure_rejected(spark: SparkSession, sf_dir: str) -> DataFrame:
    return structuring.rejected(lines(spark, sf_dir), FORMAT).select("event_id", "line")


#: Files whose first line fits.
STARTED_SQL = f"started AS (SELECT * FROM lines WHERE file IN (SELECT file FROM lines WHERE line_no = 1 AND regexp_matches(line, '{_RE}')))"


@query(f"""WITH {LINES_SQL}, {STARTED_SQL}, i AS (SELECT *, regexp_matches(line, '{_RE}') AS ok, sum(regexp_matches(line, '{_RE}')::INT) OVER (PARTITION BY file ORDER BY line_no) AS e FROM started)
SELECT file, min(line_no) AS line_no, min(event_id) FILTER (ok) AS event_id,
  string_agg(CASE WHEN ok THEN trim(regexp_extract(line, '{_RE}', 6)) ELSE trim(line) END, chr(10) ORDER BY line_no) AS "Message" FROM i GROUP BY file, e""")
def structure_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = lines(spark, sf_dir)
    first = rows.filter("line_no = 1")
    started = rows.join(structuring.parse(first, FORMAT).filter("is_valid").select("file"), "file", "left_semi")
    return structuring.structure(started, FORMAT, "append", append_to="Message").select("file", "line_no", "event_id", "Message")


@query("""SELECT event_id, trim(regexp_replace(trim(regexp_replace(trim(regexp_replace(event_type || ' 10.0.0.1 : ' || (event_id % 90) || ' ' || props, '((?:\\d{1,3}\\.){3}\\d{1,3}) : (\\d{1,5})', '\\1:\\2', 'g')),
'[{}]', '', 'g')), '"k": ', 'k=', 'g')) AS message FROM events""".replace("\\\\", "\\"))
def clean_rewrite(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events")
    text = F.concat("event_type", F.lit(" 10.0.0.1 : "), (F.col("event_id") % 90).cast("string"), F.lit(" "), "props")
    rules = [*cleaning.RULES["summary_bgl"]["Message"], (r"[{}]", ""), (r'"k": ', "k=")]
    return rows.select("event_id", cleaning.rewrite(text, rules).alias("message"))


@query("SELECT event_id, try_strptime(strftime(ts, '%m-%d %H:%M:%S') || ' ' || (2000 + event_id % 20), '%m-%d %H:%M:%S %Y') AS \"Timestamp\" FROM events")
def year_imputation(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select("event_id", F.date_format("ts", "MM-dd").alias("Date"), F.date_format("ts", "HH:mm:ss").alias("Time"))
    return cleaning.timestamped(rows, "MM-dd HH:mm:ss", year=2000 + F.col("event_id") % 20)


@query(f"""SELECT page_id, regexp_replace(regexp_replace(url, '{PATTERNS["http_url"]}', '<http_url>', 'g'), '{PATTERNS["number"]}', '<number>', 'g') AS masked FROM pages""")
def mask_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", templates.masked(F.col("url"), masks("http_url", "number")).alias("masked"))


SETTINGS = MiningSettings(0.4, 4, masks("hex_number", "number"))


@query("""SELECT event_id, event_type AS component, 1::BIGINT AS event, event_type || ' {"k": <number>}' AS template,
'[{"value":"' || regexp_extract(props, '-?\\d+') || '","mask":"number"}]' AS parameters FROM events""".replace("\\\\", "\\"))
def mine_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    mined = templates.mine_templates(entries(spark, sf_dir), SETTINGS, order=["instance", "pos"], keep=["event_id"])
    return mined.select("event_id", "component", "event", "template", F.to_json("parameters").alias("parameters"))


@query("SELECT event_id, event_type || ' ' || props AS message FROM events")
def reconstruct_message(spark: SparkSession, sf_dir: str) -> DataFrame:
    mined = templates.mine_templates(entries(spark, sf_dir), SETTINGS, order=["instance", "pos"], keep=["event_id"])
    return mined.select("event_id", templates.reconstruct(F.col("template"), F.transform("parameters", lambda p: p["value"])).alias("message"))


@query("SELECT event_id, event_type || ' ' || props AS message, event_type || ' {\"k\": <number>}' AS template FROM events")
def mine_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    mined = templates.mine_distinct(entries(spark, sf_dir), SETTINGS, order=["instance", "pos"], keep=["event_id"])
    return mined.select("event_id", templates.reconstruct(F.col("template"), F.transform("parameters", lambda p: p["value"])).alias("message"), "template")


@query("SELECT DISTINCT event_type AS component, 1::BIGINT AS event, event_type || ' {\"k\": <number>}' AS template FROM events")
def event_dictionary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return templates.event_dictionary(templates.mine_templates(entries(spark, sf_dir), SETTINGS, order=["instance", "pos"]))


@query(r"""WITH p AS (SELECT page_id, url AS value, ['java_identifier', 'linux_path', 'http_url', 'block_id', 'ipv4_address_with_port', 'number', '*', 'hex_number'][(page_id % 8) + 1] AS mask,
  ('0x' || substr(md5(url), 1, 8))::BIGINT % 100000 AS h FROM pages),
v AS (SELECT page_id, mask, h, CASE WHEN mask = 'hex_number' THEN '0x' || printf('%x', page_id) ELSE value END AS value FROM p),
l AS (SELECT *, list_transform(regexp_extract_all(value, '[a-zA-Z]+[:=.?!]?'), lambda x, i: {'n': -len(x), 'at': i, 'x': x}) AS letters FROM v)
SELECT page_id, CASE WHEN mask = 'java_identifier' THEN regexp_extract(list_filter(string_split(value, '.'), lambda x: regexp_matches(x, '^\w'))[-1], '^\w+')
  WHEN mask = 'linux_path' THEN regexp_extract_all(value, '\w+')[-1] || '-path' WHEN mask = 'http_url' THEN 'http-URL' WHEN mask = 'block_id' THEN 'block#' || h
  WHEN mask = 'ipv4_address_with_port' THEN 'remote host #' || h WHEN mask = 'hex_number' THEN page_id::VARCHAR WHEN mask = 'number' THEN value
  ELSE coalesce(list_min(letters).x, '') END AS simplified FROM l""")
def simplify_parameters(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = ["java_identifier", "linux_path", "http_url", "block_id", "ipv4_address_with_port", "number", "*", "hex_number"]
    rows = table(spark, sf_dir, "pages").select("page_id", "url", F.element_at(F.array(*[F.lit(n) for n in names]), (F.col("page_id") % 8 + 1).cast("int")).alias("mask"))
    value = F.when(F.col("mask") == "hex_number", F.concat(F.lit("0x"), F.lower(F.hex("page_id")))).otherwise(F.col("url"))
    return rows.select("page_id", templates.simplified(value, F.col("mask")).alias("simplified"))


@query("SELECT c_custkey, ('0x' || substr(md5(c_name), 1, 8))::BIGINT % 100000 AS code FROM customer")
def stable_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select("c_custkey", stable_hash(F.col("c_name"), 100_000).alias("code"))


@query("SELECT page_id, array_to_string(list_transform(regexp_extract_all(url, '\\d+|\\D+'), lambda p: CASE WHEN regexp_matches(p, '^\\d') THEN lpad(p, 20, '0') ELSE p END), '') AS sort_key FROM pages".replace("\\\\", "\\"))
def natural_sort_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", natural_key(F.col("url")).alias("sort_key"))


SIZE, STRIDE = 20, 8


@query(f"""WITH e AS (SELECT event_id, user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS i, count(*) OVER (PARTITION BY user_id) AS n FROM events),
k AS (SELECT user_id, n, unnest(generate_series(0, greatest(n - {SIZE}, 0) // {STRIDE})) AS k FROM (SELECT DISTINCT user_id, n FROM e)),
s AS (SELECT user_id, k, k * {STRIDE} AS a FROM k UNION ALL
  SELECT user_id, max(k) + 1, max(n) - {SIZE} FROM k GROUP BY user_id HAVING max(n) - max(k) * {STRIDE} - {SIZE} > 0 AND max(n) - max(k) * {STRIDE} - {SIZE} < {STRIDE})
SELECT e.event_id, e.user_id, s.k AS "window", e.i - s.a AS place FROM e JOIN s ON e.user_id = s.user_id AND e.i >= s.a AND e.i < s.a + {SIZE}""")
def sliding_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select("event_id", "user_id", "ts")
    return sequences.sliding_windows(rows, ["user_id"], ["ts", "event_id"], SIZE, STRIDE).select("event_id", "user_id", "window", "place")


PACK_SQL = """WITH RECURSIVE t AS (SELECT conv_id, turn, len(regexp_extract_all(text, '\\S+')) AS s, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS i FROM conversations),
p AS (SELECT conv_id, turn, s, i, s AS used, 0::BIGINT AS chunk FROM t WHERE i = 1 UNION ALL
  SELECT t.conv_id, t.turn, t.s, t.i, CASE WHEN p.used > 0 AND p.used + t.s > 120 THEN t.s ELSE p.used + t.s END, CASE WHEN p.used > 0 AND p.used + t.s > 120 THEN p.chunk + 1 ELSE p.chunk END
  FROM p JOIN t ON t.conv_id = p.conv_id AND t.i = p.i + 1)""".replace("\\\\", "\\")


def _turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations")
    words = F.regexp_extract_all("text", F.lit(r"\S+"), F.lit(0))
    return rows.select("conv_id", "turn", "role", words.alias("words"), F.size(words).alias("size"))


@query(f"{PACK_SQL} SELECT conv_id, turn, chunk FROM p")
def pack_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sequences.packed(_turns(spark, sf_dir), ["conv_id"], ["turn"], "size", 120).select("conv_id", "turn", "chunk")


@query(f"""{PACK_SQL} SELECT p.conv_id, p.chunk, sum(p.s)::BIGINT AS n_inputs, coalesce(sum(p.s) FILTER (c.role = 'assistant'), 0)::BIGINT AS n_labels,
md5(array_to_string(flatten(list(regexp_extract_all(c.text, '\\S+') ORDER BY p.turn)), ' ')) AS inputs_md5 FROM p JOIN conversations c ON c.conv_id = p.conv_id AND c.turn = p.turn GROUP BY p.conv_id, p.chunk""".replace("\\\\", "\\"))
def pack_and_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks = sequences.packed(_turns(spark, sf_dir), ["conv_id"], ["turn"], "size", 120)
    out = sequences.labelled_chunks(chunks, ["conv_id"], ["turn"], "words", F.col("role") == "assistant")
    return out.select("conv_id", "chunk", F.size("input_ids").cast("long").alias("n_inputs"), F.size("labels").cast("long").alias("n_labels"), F.md5(F.array_join("input_ids", " ").cast("binary")).alias("inputs_md5"))


#: Lines of documents as sentences.
SENTENCES_SQL = """s AS (SELECT doc_id, i - 1 AS idx, regexp_extract_all(l, '\\S+') AS words FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS l, generate_subscripts(string_split(text, chr(10)), 1) AS i
  FROM documents))""".replace("\\\\", "\\")


def _sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("idx", "line")).select("doc_id", "idx", F.regexp_extract_all("line", F.lit(r"\S+"), F.lit(0)).alias("words"))


CHOSEN_SQL = "row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, idx) <= round_even(count(*) OVER (PARTITION BY doc_id) * 0.3, 0)"


@query(f"""WITH {SENTENCES_SQL}, c AS (SELECT doc_id, idx, w, count(*) AS c FROM (SELECT doc_id, idx, unnest(words) AS w FROM s) GROUP BY ALL),
a AS (SELECT *, sum(c) OVER (PARTITION BY doc_id, w) - c AS r FROM c), o AS (SELECT doc_id, idx, sum(least(c, r)) AS o FROM a GROUP BY ALL),
f AS (SELECT s.doc_id, s.idx, coalesce(2 * o.o / sum(len(words)) OVER (PARTITION BY s.doc_id), 0.0)::DOUBLE AS score FROM s LEFT JOIN o ON o.doc_id = s.doc_id AND o.idx = s.idx)
SELECT doc_id, idx, round(score, 6) AS score, {CHOSEN_SQL} AS chosen FROM f""")
def gap_sentences_independent(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores = masking.document_scores(_documents(spark, sf_dir), "doc_id", "sentences", "idx")
    return masking.chosen_by_score(scores, "doc_id", "idx", 0.3).withColumn("score", F.round("score", 6))


@query(f"""WITH {SENTENCES_SQL}, f AS (SELECT doc_id, idx, ('0x' || substr(md5('7:' || doc_id || ':' || idx), 1, 8))::BIGINT::DOUBLE AS score, words FROM s)
SELECT doc_id, idx, CASE WHEN {CHOSEN_SQL} THEN '<*>' ELSE array_to_string(words, ' ') END AS masked FROM f""")
def random_gap_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _sentences(spark, sf_dir)
    chosen = masking.chosen_by_score(masking.random_scores(rows, "doc_id", "idx", 7), "doc_id", "idx", 0.3)
    joined = rows.join(chosen, ["doc_id", "idx"]).withColumn("text", F.array_join("words", " "))
    return masking.gap_masked(joined, F.col("chosen"), "text").select("doc_id", "idx", "masked")


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sentences of each document in its own row, as _sentences() has them one by one."""
    words = F.transform(F.split("text", "\n"), lambda line: F.regexp_extract_all(line, F.lit(r"\S+"), F.lit(0)))
    return table(spark, sf_dir, "documents").filter("text IS NOT NULL").select("doc_id", words.alias("sentences"))


def _shown(out: DataFrame) -> DataFrame:
    text = lambda c: F.array_join(F.transform(c, lambda s: F.array_join(s, " ")), "\n").alias(c)
    return out.select("doc_id", text("masked"), text("antimasked"))


@query()
def gap_sentences_sequential(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown(masking.masked_documents(_documents(spark, sf_dir), "sentences", "doc_id", "gap-sequential"))


@query()
def text_infilling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown(masking.masked_documents(_documents(spark, sf_dir), "sentences", "doc_id", "text-infilling", seed=5))


# Traces: a customer's orders are a trace; each order's parent is the order with half its place.
TRACE_SQL = """o AS (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS i FROM orders),
t AS (SELECT o.i AS pos, o.o_custkey::VARCHAR AS trace, CASE WHEN o.i = 1 THEN 'root' ELSE p.o_orderkey::VARCHAR END AS parent, o.o_orderkey::VARCHAR AS span FROM o LEFT JOIN o p ON p.o_custkey = o.o_custkey AND p.i = o.i // 2)"""
SPANS_SQL = f"""{TRACE_SQL}, spans AS (SELECT trace, span, parent FROM t UNION SELECT trace, 'root', NULL FROM t)"""


def _tuples(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("o_custkey").orderBy("o_orderkey")
    o = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", F.row_number().over(w).alias("i"))
    p = o.select("o_custkey", F.col("i").alias("__up"), F.col("o_orderkey").alias("__parent"))
    joined = o.withColumn("__up", F.floor(F.col("i") / 2)).join(p, ["o_custkey", "__up"], "left")
    parent = F.when(F.col("i") == 1, F.lit("root")).otherwise(F.col("__parent").cast("string"))
    return traces.from_columns(joined.select(F.col("i").cast("long").alias("pos"), "o_custkey", parent.alias("p"), "o_orderkey"), "o_custkey", "p", "o_orderkey", drop=True)


@query("""SELECT event_id, printf('%x', user_id) AS trace, printf('%x', event_id) AS span, printf('%x', event_id % 16) AS parent, 'did ' || event_type AS message FROM events WHERE value > 30""")
def trace_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events")
    code = lambda c: F.lower(F.hex(c))
    mark = F.concat(F.lit("["), code(F.col("user_id")), F.lit(", "), code(F.col("event_id")), F.lit(","), code(F.col("event_id") % 16), F.lit("] did "), "event_type")
    made = rows.select("event_id", F.when(F.col("value") > 30, mark).otherwise(F.col("event_type")).alias("message"))
    return traces.from_markers(made, remove=True).select("event_id", "trace", "span", "parent", "message")


@query(f"WITH {SPANS_SQL} SELECT trace, span, parent, FALSE AS looped FROM spans")
def trace_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return traces.forest(_tuples(spark, sf_dir))


@query(f"""WITH RECURSIVE {SPANS_SQL}, f AS (SELECT trace, span, 0::BIGINT AS depth, span AS path FROM spans WHERE parent IS NULL UNION ALL
SELECT s.trace, s.span, f.depth + 1, f.path || '/' || s.span FROM f JOIN spans s ON s.trace = f.trace AND s.parent = f.span) SELECT trace, span, depth, path FROM f""")
def trace_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return traces.paths(traces.forest(_tuples(spark, sf_dir)))


@query(f"WITH {SPANS_SQL} SELECT s.trace, coalesce(s.parent, '-') AS parent, s.span, t.pos FROM spans s LEFT JOIN t ON t.trace = s.trace AND t.span = s.span")
def trace_flatten(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _tuples(spark, sf_dir)
    return traces.flatten(traces.forest(rows), rows, ["pos"], default_parent="-")


@query(f"WITH {SPANS_SQL} SELECT trace, coalesce(parent, trace) AS src, span AS dst FROM spans")
def trace_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes, edges = traces.graph(traces.forest(_tuples(spark, sf_dir)))
    return traces.shown(edges, nodes).select("trace", "src", "dst")


@query("""WITH e AS (SELECT *, lag(event_type) OVER w AS l, row_number() OVER w AS r FROM events WINDOW w AS (PARTITION BY user_id, event_id % 5 ORDER BY ts, event_id))
SELECT user_id::VARCHAR AS trace, (event_id % 5)::VARCHAR AS span, string_agg(event_type, chr(10) ORDER BY ts, event_id) AS label FROM e WHERE r = 1 OR l <> event_type GROUP BY user_id, event_id % 5""")
def trace_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("trace"), (F.col("event_id") % 5).cast("string").alias("span"), F.struct("ts", "event_id").alias("pos"), "event_type")
    return traces.labels(rows, "event_type", distinct_lines=True)


TOKENS_SQL = r"""tok AS (SELECT lang, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+')) AS token FROM documents), v AS (SELECT lang, token, count(*) AS n FROM tok GROUP BY ALL)"""


def _vocabulary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vocabulary.vocabulary(table(spark, sf_dir, "documents"), "text", ["lang"], split_case=False)


@query(f"WITH {TOKENS_SQL} SELECT lang, token, n FROM v")
def vocabulary_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _vocabulary(spark, sf_dir)


@query(r"""SELECT token, count(*) AS n FROM (SELECT unnest(string_split(lower(regexp_replace(regexp_replace(w, '([^A-Z])([A-Z])', '\1 \2', 'g'), '([A-Z])([A-Z][a-z])', '\1 \2', 'g')), ' ')) AS token
FROM (SELECT unnest(regexp_extract_all(replace(o_orderpriority, '-', 'Level') || 'HTTPServer' || o_orderstatus || 'x', '[\p{L}\p{N}_]+')) AS w FROM orders)) GROUP BY token""")
def vocabulary_case_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").select(F.concat(F.replace("o_orderpriority", F.lit("-"), F.lit("Level")), F.lit("HTTPServer"), "o_orderstatus", F.lit("x")).alias("text"))
    return vocabulary.vocabulary(rows, "text")


_STOP = "('the', 'of', 'and', 'de', 'la')"


@query(f"""WITH {TOKENS_SQL} SELECT lang, token, n, rank FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY n DESC, token) AS rank FROM v WHERE token NOT IN {_STOP}) WHERE rank <= 50 AND n >= 10""")
def head_words_topn(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vocabulary.head(_vocabulary(spark, sf_dir), n=50, min_frequency=10, ignored=("the", "of", "and", "de", "la"), by=["lang"])


@query(f"""WITH {TOKENS_SQL}, t AS (SELECT *, sum(n) OVER (PARTITION BY lang) AS total FROM v), h AS (SELECT *, row_number() OVER w AS rank, sum(n) OVER w AS run FROM t WHERE token NOT IN {_STOP} WINDOW w AS (PARTITION BY lang ORDER BY n DESC, token))
SELECT lang, token, n, rank FROM h WHERE run <= total * 0.25""")
def head_words_percentile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vocabulary.head(_vocabulary(spark, sf_dir), percentile=0.25, ignored=("the", "of", "and", "de", "la"), by=["lang"])


@query(f"""WITH {TOKENS_SQL}, h AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY n DESC, token) AS r FROM v) WHERE r <= 500), c AS (SELECT lang, count(*) AS k FROM h GROUP BY lang),
b AS (SELECT x.lang AS a, y.lang AS b, count(*) AS s FROM h x JOIN h y ON x.token = y.token AND x.lang < y.lang GROUP BY ALL)
SELECT b.a, b.b, round(b.s / (p.k + q.k - b.s), 6) AS overlap FROM b JOIN c p ON p.lang = b.a JOIN c q ON q.lang = b.b""")
def jaccard_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    heads = vocabulary.head(_vocabulary(spark, sf_dir), n=500, by=["lang"])
    return vocabulary.jaccard(heads, "lang").withColumn("overlap", F.round("overlap", 6))


@query("SELECT lang, count(n_chars) AS n, round(avg(n_chars), 4) AS mean, round(stddev_pop(n_chars), 4) AS stdev, median(n_chars) AS median FROM documents GROUP BY lang")
def length_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vocabulary.length_stats(table(spark, sf_dir, "documents"), "n_chars", ["lang"]).withColumns({"mean": F.round("mean", 4), "stdev": F.round("stdev", 4)})


@query("""WITH q AS (SELECT o_orderpriority AS p, avg(o_totalprice) AS mean, quantile_cont(o_totalprice, 0.25) AS q1, quantile_cont(o_totalprice, 0.5) AS median, quantile_cont(o_totalprice, 0.75) AS q3, min(o_totalprice) AS lo, max(o_totalprice) AS hi, stddev_pop(o_totalprice) AS stdev FROM orders GROUP BY 1)
SELECT p AS o_orderpriority, round(mean, 3) AS mean, round(q1, 3) AS q1, round(median, 3) AS median, round(q3, 3) AS q3, round(lo, 3) AS min, round(hi, 3) AS max, round(stdev, 3) AS stdev,
round(min(o_totalprice) FILTER (o_totalprice BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1)), 3) AS whisker_low, round(max(o_totalprice) FILTER (o_totalprice BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1)), 3) AS whisker_high,
count(*) FILTER (o_totalprice < q1 - 1.5 * (q3 - q1)) AS outliers_low, count(*) FILTER (o_totalprice > q3 + 1.5 * (q3 - q1)) AS outliers_high FROM q JOIN orders ON o_orderpriority = p GROUP BY ALL""")
def box_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = vocabulary.box_stats(table(spark, sf_dir, "orders"), "o_totalprice", ["o_orderpriority"])
    return out.withColumns({c: F.round(c, 3) for c in ("mean", "q1", "median", "q3", "min", "max", "stdev", "whisker_low", "whisker_high")})


_ROUGE = """id, round(CASE WHEN np > 0 THEN s / np ELSE 0 END, 6)::DOUBLE AS precision, round(CASE WHEN nr > 0 THEN s / nr ELSE 0 END, 6)::DOUBLE AS recall, round(CASE WHEN s > 0 THEN 2 * s / (np + nr) ELSE 0 END, 6)::DOUBLE AS f1"""


def _rouge_sql(n: int, stems: bool = False, told: str = _ROUGE) -> str:
    gram = " || ' ' || ".join(f"w[i + {j}]" for j in range(n))
    words = lambda c: f"regexp_extract_all(lower({c}), '[\\p{{L}}\\p{{N}}_]+')"
    if stems:
        plain = words
        words = lambda c: f"list_transform({plain(c)}, lambda x: regexp_replace(x, '^(.{{3,}}?)(?:{'|'.join(metrics.ENDINGS)})$', '\\1'))"
    return f"""WITH p AS (SELECT u.conv_id * 1000 + u.turn AS id, {words('a.text')} AS p, {words('u.text')} AS r
  FROM conversations u JOIN conversations a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1 WHERE u.role = 'user'),
g AS (SELECT id, 'p' AS side, {gram} AS g FROM (SELECT id, p AS w, unnest(generate_series(1, len(p) - {n - 1})) AS i FROM p) UNION ALL SELECT id, 'r', {gram} FROM (SELECT id, r AS w, unnest(generate_series(1, len(r) - {n - 1})) AS i FROM p)),
c AS (SELECT id, g, count(*) FILTER (side = 'p') AS a, count(*) FILTER (side = 'r') AS b FROM g GROUP BY ALL),
s AS (SELECT id, sum(least(a, b)) AS s FROM c GROUP BY id), z AS (SELECT p.id, greatest(len(p) - {n - 1}, 0) AS np, greatest(len(r) - {n - 1}, 0) AS nr, coalesce(s.s, 0) AS s FROM p LEFT JOIN s ON s.id = p.id)
SELECT {told} FROM z"""


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations")
    user = rows.filter("role = 'user'").select("conv_id", "turn", F.col("text").alias("reference"))
    after = rows.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("prediction"))
    return user.join(after, ["conv_id", "turn"]).select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), "prediction", "reference")


def _rouge(spark: SparkSession, sf_dir: str, n: int, stems: bool = False) -> DataFrame:
    out = metrics.rouge_n(_pairs(spark, sf_dir), "id", "prediction", "reference", n, stems)
    return out.withColumns({c: F.round(c, 6) for c in ("precision", "recall", "f1")})


@query(_rouge_sql(1))
def rouge_1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rouge(spark, sf_dir, 1)


@query(_rouge_sql(2))
def rouge_2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rouge(spark, sf_dir, 2)


@query(_rouge_sql(3))
def rouge_3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rouge(spark, sf_dir, 3)


@query(_rouge_sql(4))
def rouge_4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rouge(spark, sf_dir, 4)


@query(_rouge_sql(1, stems=True))
def rouge_1_stems(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rouge(spark, sf_dir, 1, stems=True)


_SUMS = [f"({_rouge_sql(n, told='sum(s) AS s, sum(np) AS p, sum(nr) AS r')}) AS t{n}" for n in range(1, 5)]


@query(f"""SELECT round(t1.s / t1.p, 6)::DOUBLE AS precision_1, round(t2.s / t2.p, 6)::DOUBLE AS precision_2, round(CASE WHEN t1.p >= t1.r THEN 1 ELSE exp(1 - t1.r / t1.p) END, 6)::DOUBLE AS brevity,
round(CASE WHEN t1.s * t2.s * t3.s * t4.s = 0 THEN 0 ELSE CASE WHEN t1.p >= t1.r THEN 1 ELSE exp(1 - t1.r / t1.p) END
  * exp((ln(nullif(t1.s, 0) / t1.p) + ln(nullif(t2.s, 0) / t2.p) + ln(nullif(t3.s, 0) / t3.p) + ln(nullif(t4.s, 0) / t4.p)) / 4) END, 6)::DOUBLE AS bleu FROM {', '.join(_SUMS)}""")
def corpus_bleu(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = metrics.corpus_bleu(_pairs(spark, sf_dir), "id", "prediction", "reference")
    return out.select(*[F.round(c, 6).alias(c) for c in ("precision_1", "precision_2", "brevity", "bleu")])


@query("""WITH RECURSIVE p AS (SELECT u.conv_id * 1000 + u.turn AS id, regexp_extract_all(lower(a.text), '\\S+') AS a, regexp_extract_all(lower(u.text), '\\S+') AS b
  FROM conversations u JOIN conversations a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1 WHERE u.role = 'user'),
t AS (SELECT id, 0::BIGINT AS i, unnest(generate_series(0, len(b))) AS j, 0::BIGINT AS l FROM p UNION ALL
  SELECT id, i, j, max(c) OVER (PARTITION BY id ORDER BY j) AS l FROM (SELECT t.id, t.i + 1 AS i, t.j, greatest(t.l, CASE WHEN t.j > 0 AND p.a[t.i + 1] = p.b[t.j] THEN lag(t.l) OVER (PARTITION BY t.id ORDER BY t.j) + 1 ELSE 0 END) AS c
  FROM t JOIN p ON p.id = t.id WHERE t.i < len(p.a))),
s AS (SELECT p.id, len(a) AS x, len(b) AS y, t.l AS l FROM p JOIN t ON t.id = p.id AND t.i = len(a) AND t.j = len(b))
SELECT id, round(CASE WHEN l > 0 THEN 2 * l / (x + y) ELSE 0 END, 6)::DOUBLE AS rouge_l, round(CASE WHEN l > 0 THEN l / x ELSE 0 END, 6)::DOUBLE AS rouge_l_precision, round(CASE WHEN l > 0 THEN l / y ELSE 0 END, 6)::DOUBLE AS rouge_l_recall FROM s""".replace("\\\\", "\\"))
def rouge_l(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = metrics.sequence_metrics(_pairs(spark, sf_dir), "id", "prediction", "reference")
    return out.select("id", *[F.round(c, 6).alias(c) for c in ("rouge_l", "rouge_l_precision", "rouge_l_recall")])


@query()
def rouge_l_bleu_meteor(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.sequence_metrics(_pairs(spark, sf_dir), "id", "prediction", "reference")


@query("SELECT doc_id, lang = 'en' AS in_train, lang = 'de' OR source = 'de' AS in_eval FROM documents")
def train_eval_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", F.array("lang", "source").alias("category"))
    return sequences.split_by_category(docs, "en", "de").drop("category")


@query(f"""{PACK_SQL} SELECT p.conv_id, sum(p.s)::BIGINT AS n_inputs, max(c.role) AS labels FROM p JOIN (SELECT conv_id, 'summary ' || conv_id AS role FROM conversations GROUP BY conv_id) c ON c.conv_id = p.conv_id WHERE chunk = 0 GROUP BY p.conv_id""")
def manual_summary_first_chunk(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks = sequences.labelled_chunks(sequences.packed(_turns(spark, sf_dir), ["conv_id"], ["turn"], "size", 120), ["conv_id"], ["turn"], "words", F.lit(False))
    summaries = chunks.select("conv_id").distinct().withColumn("summary", F.concat(F.lit("summary "), F.col("conv_id").cast("string")))
    return sequences.first_chunk_with_summary(chunks, summaries, "conv_id").select("conv_id", F.size("input_ids").cast("long").alias("n_inputs"), "labels")


@query("SELECT o_custkey, array_to_string(list_concat(list(o_orderkey % 50 ORDER BY o_orderkey), list_transform(range(greatest(0, 40 - count(*))), lambda x: 0)), ' ') AS padded, len(string_split(array_to_string(list(o_orderkey % 50 ORDER BY o_orderkey), ' '), ' '))::INT AS n FROM orders GROUP BY o_custkey")
def padded_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = F.transform(F.sort_array(F.collect_list("o_orderkey")), lambda x: (x % 50).cast("int"))
    rows = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(ids.alias("ids"))
    return rows.select("o_custkey", F.array_join(sequences.padded(F.col("ids"), 40, 0).cast("array<string>"), " ").alias("padded"), F.size("ids").alias("n"))


@query("""WITH i AS (SELECT o_custkey, o_orderkey % 5 AS v, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS i FROM orders), p AS (SELECT *, sum((v = 3 AND i > 1)::INT) OVER (PARTITION BY o_custkey ORDER BY i) AS k FROM i)
SELECT o_custkey, k::INT AS piece, string_agg(v::VARCHAR, ' ' ORDER BY i) AS ids FROM p GROUP BY o_custkey, k""")
def split_by_token(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = F.transform(F.sort_array(F.collect_list("o_orderkey")), lambda x: (x % 5).cast("int"))
    rows = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(ids.alias("ids"))
    pieces = rows.select("o_custkey", F.posexplode(sequences.split_at(F.col("ids"), 3)).alias("piece", "part"))
    return pieces.select("o_custkey", "piece", F.array_join(F.col("part").cast("array<string>"), " ").alias("ids"))


def _code(token: str) -> int:
    return 10 + sum(token.encode()) % 5000


@query()
def tokenize_and_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = masking.training_pairs(_documents(spark, sf_dir), "sentences", "doc_id", "text-infilling", _code, separator=2, sentence_max=256, seed=3)
    text = lambda c: F.array_join(F.col(c).cast("array<string>"), " ").alias(c)
    return out.select("doc_id", text("input_ids"), text("labels"), F.size(sequences.without_ignored(F.col("labels"))).alias("n_labels"))


@query(f"""{PACK_SQL} SELECT p.conv_id, p.chunk FROM p JOIN conversations c ON c.conv_id = p.conv_id AND c.turn = p.turn GROUP BY p.conv_id, p.chunk HAVING sum(p.s) > 100 OR sum(p.s) FILTER (c.role = 'assistant') > 0""")
def empty_reference_policy(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks = sequences.packed(_turns(spark, sf_dir), ["conv_id"], ["turn"], "size", 120)
    out = sequences.labelled_chunks(chunks, ["conv_id"], ["turn"], "words", F.col("role") == "assistant")
    return sequences.kept_references(out, "train_only", F.size("input_ids") > 100).select("conv_id", "chunk")


@query("SELECT c_custkey, round(exp(c_acctbal / 2000), 6) AS perplexity, CASE WHEN c_nationkey > 0 THEN round(c_custkey / c_nationkey, 6) END AS per_second FROM customer")
def derived_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "customer")
    return rows.select("c_custkey", F.round(metrics.perplexity(F.col("c_acctbal") / 2000), 6).alias("perplexity"), F.round(metrics.throughput(F.col("c_custkey"), F.col("c_nationkey")), 6).alias("per_second"))


@query("""WITH s AS (SELECT o_custkey, string_agg((o_orderkey % 7)::VARCHAR, '' ORDER BY o_orderkey) AS s FROM orders GROUP BY o_custkey)
SELECT o_custkey, array_to_string(regexp_extract_all(s, '3[^35]*5?'), ' ') AS runs FROM s""")
def decode_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = F.transform(F.sort_array(F.collect_list("o_orderkey")), lambda x: (x % 7).cast("int"))
    rows = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(ids.alias("ids"))
    runs = F.transform(sequences.between(F.col("ids"), 3, 5), lambda r: F.array_join(r.cast("array<string>"), ""))
    return rows.select("o_custkey", F.array_join(runs, " ").alias("runs"))


@query("""WITH e AS (SELECT event_id, user_id, ts, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events),
r AS (SELECT user_id, max(i) FILTER (event_type = 'error') AS last FROM e GROUP BY user_id) SELECT e.user_id, string_agg(event_type, chr(10) ORDER BY i) || chr(10) AS value FROM e JOIN r ON r.user_id = e.user_id WHERE e.i >= coalesce(r.last, 1) GROUP BY e.user_id""")
def text_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = LogWindows(partition_patterns=("error",)).build(entries(spark, sf_dir))
    last = parts.groupBy("instance").agg(F.max("partition_id").alias("partition_id"))
    rows = parts.join(last, ["instance", "partition_id"]).groupBy("instance").agg(F.sort_array(F.collect_list(F.struct("pos", "component"))).alias("l"))
    return rows.select(F.col("instance").alias("user_id"), sinks.block(F.transform("l", lambda x: x["component"])).alias("value"))
