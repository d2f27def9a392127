"""Tokenized sentences, sequences, graphs with attributes, diagnosed instances, templates apart, statistics as a command."""

import io
import json
import sys

import pyarrow as pa
from pyspark.sql import functions as F

from emberlog.__main__ import main
from emberlog.operators import sequences, traces
from emberlog.plans import preprocess, statistics
from emberlog.sources import readers


def test_tokenized_sentences(spark):
    encode = lambda text: [ord(c) for c in text]
    rows = spark.createDataFrame([("a", 1, "xy"), ("a", 2, "zw"), (None, 1, None), ("b", 5, "xy")], "g string, i long, t string")
    found = {(r.g, r.i): list(map(chr, r.input_ids)) for r in sequences.tokenized(rows, ["g"], ["i"], "t", encode, separator=";").collect()}
    assert found == {("a", 1): ["x", "y"], ("a", 2): [";", "z", "w"], (None, 1): [], ("b", 5): ["x", "y"]}
    cut = {(r.g, r.i): r.input_ids for r in sequences.tokenized(rows, ["g"], ["i"], "t", encode, most=3, bos=[1], eos=[2]).collect()}
    assert cut["a", 1] == [1, ord("x"), 2] and cut[None, 1] == [1, 2]
    share = sequences.tokenized(rows, ["g"], ["i"], "t", encode, separator=";", most=0.25, model_length=8).collect()
    assert {(r.g, r.i): len(r.input_ids) for r in share}["a", 2] == 2


def test_sequences_between_tokens(spark):
    row = spark.createDataFrame([([7, 1, 3, 1, 4, 2, 9, 1, 5],)], "ids array<int>")
    both = lambda **k: row.select(sequences.sequences_of(F.col("ids"), **k).alias("s")).first()["s"]
    assert both(begin=1, end=2) == [[1, 3], [1, 4, 2], [1, 5]]
    assert both(begin=1) == [[7], [1, 3], [1, 4, 2, 9], [1, 5]]
    assert both(end=2) == [[7, 1, 3, 1, 4, 2], [9, 1, 5]]
    assert both() == [[7, 1, 3, 1, 4, 2, 9, 1, 5]]


def test_graphs_keep_attributes_and_build(spark):
    rows = spark.createDataFrame([(1, "t", "0", "1", "m1"), (2, "t", "0", "1", "m2"), (3, "t", "1", "2", "m3"), (4, None, "0", "5", "m4")], "pos long, trace string, parent string, span string, message string")
    spans = traces.forest(rows)
    nodes, edges = traces.graph(spans, rows, ["message"])
    held = {(r.trace, r.node, r.kind): [a.message for a in r.attributes] for r in nodes.collect()}
    assert held == {("t", "0", "span"): [], ("t", "1", "span"): ["m1", "m2"], ("t", "2", "span"): ["m3"], ("t", "t", "trace"): [], (None, "0", "span"): [], (None, "5", "span"): ["m4"], (None, None, "trace"): []}

    def build(n: pa.Table, e: pa.Table) -> pa.Table:
        return pa.table({"trace": n.column("trace").slice(0, 1), "nodes": [n.num_rows], "edges": [e.num_rows]})

    made = {r.trace: (r.nodes, r.edges) for r in traces.constructed(nodes, edges, build, "trace string, nodes long, edges long").collect()}
    assert made == {"t": (4, 3), None: (3, 2)}


def test_diagnosed_instances(spark, tmp_path):
    for name, text in {
        "anomaly12/cpu/3/hiapplogcat.1": "a",
        "anomaly12/RD.txt": "Fault time: 2020-01-02 03:04:05\nRoot cause:\nfull disk",
        "anomaly7/net/x/logs/hiapplogcat.2": "b",
        "anomaly7/net/rd.txt": "2021-01-01 00:00:00\nnothing said",
        "anomaly7/rD.txt": "Root cause: cable",
        "anomaly7/net/x/other.txt": "c",
    }.items():
        path = tmp_path / "set" / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(text)
    lines = readers.read_lines(spark, str(tmp_path / "set"), recursive=True)
    instances, logs = readers.diagnosed_instances(lines, str(tmp_path / "set"))
    found = {r.instance: (r.category, str(r.fault_time), r.analysis) for r in instances.collect()}
    assert found == {"12_cpu_3": (["anomaly12", "cpu"], "2020-01-02 03:04:05", "full disk"), "7_net_1": (["anomaly7", "net"], "2021-01-01 00:00:00", "cable")}
    assert sorted((r.instance, r.line) for r in logs.collect()) == [("12_cpu_3", "a"), ("7_net_1", "b")]


def test_templates_apart_from_standard_input(spark, tmp_path, monkeypatch):
    text = "id,message\n" + "".join(f"{i},open file {i}\n" for i in range(20))
    monkeypatch.setattr(sys, "stdin", io.TextIOWrapper(io.BytesIO(text.encode())))
    assert main(["abstract", "message", "-", str(tmp_path / "rows"), "--templates", str(tmp_path / "templates")]) == 0
    rows, kinds = spark.read.parquet(str(tmp_path / "rows")), spark.read.parquet(str(tmp_path / "templates"))
    assert rows.count() == 20 and "template" not in rows.columns
    assert [(r.event, r.template) for r in kinds.collect()] == [(1, "open file <*>")]


def test_statistics_as_a_command(spark, tmp_path):
    (tmp_path / "a.csv").write_text("text\none two two\nthree\n")
    (tmp_path / "b.csv").write_text('text\n"two, four"\n')
    assert main(["statistics", "text", str(tmp_path / "out"), f"a={tmp_path}/a.csv", f"b={tmp_path}/b.csv", "--percentile", "1"]) == 0
    told = {r.dataset: r for r in spark.read.json(str(tmp_path / "out" / "datasets")).collect()}
    assert (told["a"].documents, told["a"].words, told["a"].mean, told["a"].median, told["a"].vocabulary, told["a"].head) == (2, 4, 2.0, 2.0, 3, 3)
    overlap = spark.read.json(str(tmp_path / "out" / "overlaps")).collect()
    assert [(r.a, r.b, r.overlap) for r in overlap] == [("a", "b", 0.25)]
    json.dumps([r.asDict() for r in overlap])


def test_statistics_of_null_and_empty_sets(spark):
    rows = spark.createDataFrame([(None, "a b"), ("x", None), ("x", "")], "d string, t string")
    found = {r.dataset: r for r in statistics.dataset_statistics(rows, "d", "t")[0].collect()}
    assert (found[None].words, found[None].vocabulary) == (2, 2) and (found["x"].words, found["x"].vocabulary, found["x"].head) == (0, 0, 0)
    assert statistics.dataset_statistics(rows.limit(0), "d", "t")[0].collect() == []


def test_years_come_from_the_instance(spark):
    import datetime

    lines = spark.createDataFrame([("i", "f", 1, "02-29 03:04:05.678  11  12 I Radio: link lost on cell 7"), ("j", "f", 1, "03-01 00:00:00.000  11  12 I Radio: link lost on cell 8")], "instance string, file string, line_no long, line string")
    instances = spark.createDataFrame([("i", datetime.datetime(2020, 3, 1)), ("j", None)], "instance string, fault_time timestamp_ntz")
    entries, kinds = preprocess.process_logs(lines, "telcoapp", instances)
    found = {r.instance: (str(r.Timestamp), r.Component, r.Message) for r in entries.collect()}
    assert found["i"] == ("2020-02-29 03:04:05.678000", "Radio", "link lost on cell 7") and set(found) == {"i", "j"}
    assert kinds.count() == 1
