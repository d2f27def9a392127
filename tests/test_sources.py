"""Readers, writers, the whole way from lines to events, streams."""

import json

from pyspark.sql import functions as F

from emberlog.operators.windows import LogWindows
from emberlog.plans import preprocess
from emberlog.sources import readers, sinks
from emberlog.streaming import streams


def test_lines_keep_numbers_and_mend_bytes(spark, tmp_path):
    (tmp_path / "x.log").write_bytes(b"one\ntw\xffo\nthree\n")
    rows = readers.read_lines(spark, str(tmp_path), "*.log").orderBy("line_no").collect()
    assert [(r["file"], r["line_no"], r["line"]) for r in rows] == [("x.log", 1, "one"), ("x.log", 2, "tw�o"), ("x.log", 3, "three")]


def test_label_summary_and_diagnosis_files(lines_of):
    labels = readers.label_file(lines_of(["### PageRank", "Normal:", "+ app_1", "", "Disk full:", "+ app_2"])).orderBy("instance").collect()
    assert [(r["instance"], r["category"]) for r in labels] == [("app_1", ["Normal", "PageRank"]), ("app_2", ["Disk full", "PageRank"])]
    instances, logs = readers.summary_file(lines_of(["#a", "l1", "l2", "#summary:#", "s1; s2;", "#b", "l3", "#summary:#", "s3"]), "bgl")
    assert {(r["instance"], tuple(r["summary"])) for r in instances.collect()} == {("bgl_0", ("s1", "s2")), ("bgl_1", ("s3",))}
    assert [(r["instance"], r["line"]) for r in logs.orderBy("line_no").collect()] == [("bgl_0", "l1"), ("bgl_0", "l2"), ("bgl_1", "l3")]
    row = readers.diagnosis_file(lines_of(["2020-01-02 03:04:05", "Root cause:", "weak signal", "Fault time: bad"])).first()
    assert row["fault_time"] is None and row["analysis"] == "weak signal"


def test_instances_and_csv(spark, tmp_path):
    (tmp_path / "i.json").write_text(json.dumps({"a": {"category": ["x"], "fault_time": "2020-01-02 03:04:05"}}))
    row = readers.read_instances(spark, str(tmp_path / "i.json")).first()
    assert row["instance"] == "a" and row["category"] == ["x"] and str(row["fault_time"]) == "2020-01-02 03:04:05"
    (tmp_path / "run1.csv").write_text('m,n\n"a ""q"" b",1\n')
    row = readers.read_csv_entries(spark, str(tmp_path / "run1.csv")).first()
    assert (row["instance"], row["m"], row["n"]) == ("run1", 'a "q" b', "1")
    assert readers.csv_column(spark, str(tmp_path / "run1.csv"), 1).count() == 2


def test_traces_from_several_files(spark, tmp_path):
    (tmp_path / "m.csv").write_text('message\n"[a, 1, 0] x"\n')
    (tmp_path / "e.csv").write_text("t,s,p\nb,2,1\n")
    rows = readers.trace_tuples_from_csv(spark, [{"path": str(tmp_path / "m.csv"), "message": "message"}, {"path": str(tmp_path / "e.csv"), "trace": "t", "span": "s", "parent": "p"}])
    assert [(r["trace"], r["span"], r["parent"]) for r in rows.orderBy("pos").collect()] == [("a", "1", "0"), ("b", "2", "1")]


def test_from_lines_to_events(spark, tmp_path):
    lines = [
        "2020-01-01 00:00:01,000 INFO [main] org.a.b.Client: connected to 10.0.0.1:80",
        "2020-01-01 00:00:03,000 ERROR [main] org.a.b.Client: failed on 10.0.0.2:81",
        "  because of the disk",
        "2020-01-01 00:00:02,000 INFO [main] org.a.b.Client: connected to 10.0.0.3:82",
    ]
    rows = spark.createDataFrame([(i, f"{i}.log", n + 1, x) for i in ("r1", "r2") for n, x in enumerate(lines)], "instance string, file string, line_no long, line string")
    instances = spark.createDataFrame([("r1", ["bad"]), ("r2", ["good"])], "instance string, category array<string>")
    entries, kinds = preprocess.process_logs(rows, "hadoop")
    told = entries.filter("instance = 'r1'").orderBy("pos").collect()
    assert [r["Message"] for r in told] == ["connected to 10.0.0.1:80", "connected to 10.0.0.3:82", "failed on 10.0.0.2:81 because of the disk"]
    assert told[0]["SimplifiedMessage"].startswith("connected to remote host #") and told[0]["Parameters"] == ["10.0.0.1:80"]
    assert kinds.count() == 2
    spec = LogWindows(categories=(("bad",),))
    assert preprocess.analyse(entries, instances, kinds, spec, "common-events").count() == 2
    assert preprocess.analyse(entries, instances, kinds, spec, "window-stats").first()["seconds"] == 2.0
    chunks = preprocess.summary_chunks(entries, instances, spec, max_length=6).collect()
    assert sum(len(c["input_ids"]) for c in chunks) == sum(len(r["SimplifiedMessage"].split()) for r in told)
    sinks.write_dataset(entries, kinds, instances, str(tmp_path / "d"))
    assert spark.read.parquet(str(tmp_path / "d/entries")).filter("instance = 'r2'").count() == 3
    sinks.write_entries(entries.limit(0), str(tmp_path / "none"), "csv")


def test_text_blocks(spark):
    row = sinks.text_blocks(spark.createDataFrame([([" a ", "", None, "b"],)], "x array<string>"), "x").first()
    assert row["value"] == "a\nb\n"


def test_stream_counts(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.log").write_text("2020-01-01 00:00:01 up: x\nbad\n2020-01-01 00:00:02 up: y\n2020-01-01 02:00:00 down: z\n")
    entries = streams.structured_stream(streams.line_stream(spark, str(tmp_path / "in")), "<Date> <Time> <Component>: <Message>", "yyyy-MM-dd HH:mm:ss")
    query = streams.counts(entries, "ts", "Component", "1 hour").writeStream.outputMode("append").format("memory").queryName("counted").option("checkpointLocation", str(tmp_path / "c")).start()
    query.processAllAvailable()
    query.stop()
    assert [(r["Component"], r["n"]) for r in spark.sql("SELECT * FROM counted").collect()] == [("up", 2)]
    assert F is not None


def test_line_numbers_of_a_file_in_many_splits(spark, tmp_path):
    lines = [f"line {i} " + "x" * (i * 7919 % 300) for i in range(1, 4001)]
    (tmp_path / "a.log").write_text("\n".join(lines) + "\n")
    (tmp_path / "b.log").write_text("\n".join(lines[:10]))
    (tmp_path / "c.log").write_text("")
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
        spark.conf.set("spark.sql.files.openCostInBytes", "0")
        found = readers.read_lines(spark, str(tmp_path))
        rows = found.collect()
        assert found.rdd.getNumPartitions() > 10
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert sorted((r["line_no"], r["line"]) for r in rows if r["file"] == "a.log") == [(i, x) for i, x in enumerate(lines, 1)]
    assert sorted((r["line_no"], r["line"]) for r in rows if r["file"] == "b.log") == [(i, x) for i, x in enumerate(lines[:10], 1)]
    assert "Window" not in found._jdf.queryExecution().executedPlan().toString()
