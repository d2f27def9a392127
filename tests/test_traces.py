"""Forests, paths, flattening."""

import itertools

from emberlog.operators import traces

# Fixed values: (trace, span, parent) in order.
EDGES = [("a", "1", "0"), ("a", "2", "1"), ("a", "3", "0"), ("a", "4", "1"), ("a", "5", "3"), ("a", "0", "6"), ("b", "1", "0"), ("b", "2", "0"), ("b", "3", "1"), ("b", "5", "4"), ("b", "4", "0")]


def _tuples(spark, edges):
    return spark.createDataFrame([(i, *e) for i, e in enumerate(edges)], "pos long, trace string, span string, parent string")


def _paths(spark, edges):
    return {(r["trace"], r["path"]) for r in traces.paths(traces.forest(_tuples(spark, edges))).collect()}


def test_forest_and_paths(spark):
    found = _paths(spark, EDGES)
    assert ("a", "6/0/1/4") in found and ("a", "6/0/3/5") in found and ("b", "0/4/5") in found and ("b", "0/1/3") in found
    spans = traces.forest(_tuples(spark, EDGES))
    assert {r["path"] for r in traces.find(spans, "1").collect()} == {"a/6/0/1", "b/0/1"}
    assert traces.find(spans, "9").count() == 0


def test_order_does_not_matter(spark):
    expected = _paths(spark, EDGES[:5])
    for edges in itertools.islice(itertools.permutations(EDGES[:5]), 0, 120, 29):
        assert _paths(spark, edges) == expected


def test_last_parent_counts_and_cycles_go(spark):
    assert ("t", "q/x") in _paths(spark, [("t", "x", "p"), ("t", "x", "q")])
    assert _paths(spark, [("t", "x", "y"), ("t", "y", "x"), ("t", "z", "r")]) == {("t", "r"), ("t", "r/z")}
    looped = traces.forest(_tuples(spark, [("t", "0", "0")])).first()
    assert looped["looped"] and looped["parent"] is None


def test_deep_and_wide_forests(spark):
    chain = spark.range(3000).selectExpr("'t' AS trace", "cast(id AS string) AS span", "CASE WHEN id > 0 THEN cast(id - 1 AS string) END AS parent")
    wide = spark.range(200_000).selectExpr("'w' AS trace", "cast(id AS string) AS span", "CASE WHEN id > 0 THEN '0' END AS parent")
    many = spark.range(1_000_000).selectExpr("cast(id % 1000 AS string) AS trace", "cast(id AS string) AS span", "CASE WHEN id >= 1000 THEN cast((id div 1000 - 1) div 2 * 1000 + id % 1000 AS string) END AS parent")
    found = traces.paths(chain.unionByName(wide).unionByName(many))
    assert found.count() == 3000 + 200_000 + 1_000_000
    deepest = found.filter("trace = 't' AND span = '2999'").first()
    assert deepest["depth"] == 2999 and deepest["path"] == "/".join(map(str, range(3000)))
    assert found.filter("trace = 'w' AND depth = 1 AND path = concat('0/', span)").count() == 199_999
    assert found.filter("size(split(path, '/')) <> depth + 1").count() == 0


def test_markers(spark):
    rows = spark.createDataFrame([("[A, 1,0] did it",), ("no marker",), ("x [a, 2, 1]",)], "message string")
    out = traces.from_markers(rows, remove=True).collect()
    assert [(r["trace"], r["span"], r["parent"], r["message"]) for r in out] == [("A", "1", "0", "did it")]
    anywhere = traces.from_markers(rows, prefix_only=False, remove=True).orderBy("span").collect()
    assert anywhere[1]["message"] == "x"


def test_flatten_gives_the_tuples_back(spark):
    rows = _tuples(spark, EDGES)
    spans = traces.forest(rows)
    assert {(r["trace"], r["span"], r["parent"], r["pos"]) for r in traces.flatten(spans, rows, ["pos"]).collect()} == {(*e, i) for i, e in enumerate(EDGES)}
    assert traces.flatten(spans, rows, ["pos"], default_parent="-").count() == len(EDGES) + 2


def test_wrapped(spark):
    from pyspark.sql import functions as F

    row = spark.createDataFrame([("one two three  four",)], "t string").select(traces.wrapped(F.col("t"), 8).alias("w")).first()
    assert row["w"] == "one two\nthree\nfour"


def test_spans_of_a_null_trace_stay(spark):
    rows = spark.createDataFrame([(1, None, "0", "1"), (2, None, "1", "2"), (3, None, "2", "3"), (4, "t", "0", "1")], "pos long, trace string, parent string, span string")
    spans = traces.forest(rows)
    assert sorted((r["trace"] or "", r["path"]) for r in traces.paths(spans).collect()) == [("", "0"), ("", "0/1"), ("", "0/1/2"), ("", "0/1/2/3"), ("t", "0"), ("t", "0/1")]
    assert traces.flatten(spans, rows, ["pos"]).filter("pos IS NOT NULL").count() == 4
