"""Windows, event sets, orders, sequences, vocabularies."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from emberlog.operators import events, ordering, sequences, vocabulary, windows
from emberlog.sources.readers import as_arguments, load_options

T0 = dt.datetime(2020, 1, 1)


def _rows(spark, messages, step=1):
    return spark.createDataFrame([("i", n, T0 + dt.timedelta(seconds=n * step), m) for n, m in enumerate(messages)], "instance string, pos long, ts timestamp_ntz, message string")


def _parts(df):
    by = {}
    for r in df.orderBy("pos").collect():
        by.setdefault(r["partition_id"], []).append(r["message"])
    return list(by.values())


def test_partitions(spark):
    rows = _rows(spark, ["p", "A", "x", "A", "y"])
    assert _parts(windows.LogWindows(partition_patterns=("A",)).build(rows)) == [["p"], ["A", "x"], ["A", "y"]]
    assert _parts(windows.LogWindows(partition_patterns=("A",), must_include_pattern=True).build(rows)) == [["A", "x"], ["A", "y"]]
    assert _parts(windows.LogWindows().build(rows)) == [["p", "A", "x", "A", "y"]]
    assert _parts(windows.LogWindows(partition_patterns=("A",), minimum_size=2).build(rows)) == [["A", "x"], ["A", "y"]]


def test_frames(spark):
    rows = _rows(spark, ["p", "A", "x", "A", "y"])
    out = windows.LogWindows(frame_patterns=("A",), frame_bounds=(-1000, 1000)).build(rows).collect()
    by = {}
    for r in out:
        by.setdefault(r["anchor"], set()).add(r["pos"])
    assert by == {1: {0, 1, 2}, 3: {2, 3, 4}}
    until = windows.LogWindows(frame_patterns=("y",), frame_bounds=(None, 0)).build(rows)
    assert until.count() == 5


@pytest.mark.parametrize("sets, expected", [((), {0: {1}, 1: {1}}), (([{1, 2}, {2, 3}, {4}]), {0: set(), 1: set()}), ([{1}, {2}, {3}], {0: set(), 1: {3}})])
def test_common_events(spark, sets, expected):
    sets = sets or [{1, 2}, {1, 3}]
    rows = spark.createDataFrame([(w, e) for w, s in enumerate(sets) for e in s], "w long, e long")
    assert {r["e"] for r in events.common_events(rows, ["w"], ["e"]).collect()} == expected[0]
    # Once the running set is empty, the next window starts anew.
    want = set()
    for s in sets:
        want = want & s if want else set(s)
    assert {r["e"] for r in events.common_events_in_order(rows, ["w"], ["w"], ["e"]).collect()} == want


def test_duration_is_last_less_first_in_order(spark):
    rows = spark.createDataFrame([("i", 0, T0), ("i", 1, T0 - dt.timedelta(seconds=5))], "instance string, pos long, ts timestamp_ntz")
    assert events.window_stats(rows, ["instance"]).first()["seconds"] == -5.0


def test_options(tmp_path, spark):
    path = tmp_path / "c.json"
    path.write_text(json.dumps([["category", ["Disk full", "PageRank"]], ["group-by-columns", "File"], ["partition-must-include-pattern"], ["frame-time-range-ms", [None, 0]], ["frame-patterns", ["x"]]]))
    spec = windows.LogWindows.from_options(load_options(str(path)))
    assert spec.categories == (("Disk full", "PageRank"),) and spec.group_by == ("File",) and spec.must_include_pattern and spec.frame_bounds == (None, 0)
    assert as_arguments({"a": [1, 2], "b": True, "c": None}) == ["--a", "1", "2", "--b", "--c", "None"]
    with pytest.raises(ValueError):
        windows.LogWindows.from_options({"unknown": 1})


def test_categories(spark):
    rows = spark.createDataFrame([("a", ["x", "y"]), ("b", ["x"])], "instance string, category array<string>")
    names = lambda *s: {r["instance"] for r in windows.category_filter(rows, *s).collect()}
    assert names() == {"a", "b"} and names(["x", "y"]) == {"a"} and names([]) == {"a", "b"} and names(["y"], ["x"]) == {"a", "b"} and names(["z"]) == set()


def _reference_windows(n, size, stride):
    if n == 0:
        return []
    out, start = [list(range(min(n, size)))], stride
    while start + size <= n:
        out.append(list(range(start, start + size)))
        start += stride
    left = n - (start - stride + size)
    if 0 < left < stride:
        out.append(list(range(n - size, n)))
    return out


def test_sliding_windows(spark):
    cases = [(n, s, d) for n in (1, 3, 7, 8, 9, 12) for s in (3, 4) for d in (1, 2, 3, 5)]
    rows = spark.createDataFrame([(n, i) for n in {c[0] for c in cases} for i in range(n)], "n long, i long")
    for size, stride in {(s, d) for _, s, d in cases}:
        got = {}
        for r in sequences.sliding_windows(rows, ["n"], ["i"], size, stride).collect():
            got.setdefault((r["n"], r["window"]), {})[r["place"]] = r["i"]
        for n in {c[0] for c in cases}:
            mine = [[w[k] for k in sorted(w)] for (m, _), w in sorted(got.items()) if m == n]
            assert mine == _reference_windows(n, size, stride), (n, size, stride)


def test_packing_keeps_order_and_bound(spark):
    sizes = [3, 4, 5, 20, 1, 1, 9, 0]
    rows = spark.createDataFrame([("g", i, s) for i, s in enumerate(sizes)], "g string, i long, s int")
    out = [r["chunk"] for r in sequences.packed(rows, ["g"], ["i"], "s", 10).orderBy("i").collect()]
    assert out == [0, 0, 1, 2, 3, 3, 4, 4]


def test_split_and_pad(spark):
    row = spark.range(1).select(
        sequences.split_at(F.lit([1, 9, 2, 9]).cast("array<int>"), 9).alias("begin"),
        sequences.split_at(F.lit([1, 9, 2, 9]).cast("array<int>"), 9, at_end=True).alias("end"),
        sequences.between(F.lit([1, 7, 2, 8, 3, 7, 4]).cast("array<int>"), 7, 8).alias("runs"),
        sequences.padded(F.lit([1]).cast("array<int>"), 3, 0).alias("pad"),
    ).first()
    assert row["begin"] == [[1], [9, 2], [9]] and row["end"] == [[1, 9], [2, 9]] and row["runs"] == [[7, 2, 8], [7, 4]] and row["pad"] == [1, 0, 0]


def test_orders(spark):
    rows = spark.createDataFrame([("a", 1, "x"), ("a", 2, "x"), ("a", 3, None), ("a", 4, None), ("a", 5, "x")], "k string, i long, v string")
    assert [r["i"] for r in ordering.consecutive_distinct(rows, ["k"], ["i"], "v").orderBy("i").collect()] == [1, 3, 5]
    assert [r["i"] for r in ordering.top_k(rows, 2, [F.desc("i")]).collect()] == [5, 4]
    assert ordering.limit_by_source(rows, {"a": 0}, None, "k", ["i"]).count() == 0


def test_vocabulary(spark):
    rows = spark.createDataFrame([("parseHTTPHeader fooBar",), (None,)], "t string")
    assert {r["token"] for r in vocabulary.vocabulary(rows, "t").collect()} == {"parse", "http", "header", "foo", "bar"}
