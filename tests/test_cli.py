"""The command line, from log files to common events."""

import json

from emberlog.__main__ import main


def test_lists(capsys):
    assert main(["formats"]) == 0 and "zookeeper" in capsys.readouterr().out
    assert main(["formats", "<a> <b>"]) == 0 and "a,b" in capsys.readouterr().out
    assert main(["presets"]) == 0 and "proxifier" in capsys.readouterr().out


def test_structure_and_abstract(spark, tmp_path):
    (tmp_path / "x.log").write_text("a: one 1\n  more\nb: two 2\n")
    assert main(["structure", "<k>: <v>", str(tmp_path / "x.log"), str(tmp_path / "out"), "-e", ":v: ", "--line-number", "no"]) == 0
    rows = spark.read.csv(str(tmp_path / "out"), header=True).orderBy("k").collect()
    assert [(r["k"], r["v"]) for r in rows] == [("a", "one 1 more"), ("b", "two 2")]
    assert main(["abstract", "v", str(tmp_path / "out"), str(tmp_path / "mined"), "-p", "bgl"]) == 0
    assert spark.read.parquet(str(tmp_path / "mined")).filter("template = 'two <number>'").count() == 1


def test_preprocess_and_analyse(spark, tmp_path):
    source = tmp_path / "logs"
    for name in ("app_1", "app_2"):
        (source / name).mkdir(parents=True)
        (source / name / "c.log").write_text("2020-01-01 00:00:01,000 INFO [main] a.b.C: disk full on node=7\n2020-01-01 00:00:02,000 INFO [main] a.b.C: done\n")
    (source / "abnormal_label.txt").write_text("### App\nDisk full:\n+ app_1\nNormal:\n+ app_2\n")
    assert main(["preprocess", "hadoop", str(source), str(tmp_path / "set")]) == 0
    (tmp_path / "c.json").write_text(json.dumps({"category": ["Disk full"]}))
    assert main(["analyse", str(tmp_path / "set"), str(tmp_path / "out"), "--config", str(tmp_path / "c.json"), "--output-type", "common-events"]) == 0
    assert spark.read.parquet(str(tmp_path / "out")).count() == 2
