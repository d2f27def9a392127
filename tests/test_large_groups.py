"""Places, packing, selection, ordered folds and counters: operators for groups that no task holds, against plain Python."""

import itertools
import random
import statistics

import numpy as np
import pytest
from pyspark.sql import functions as F

from emberlog.operators import chains, events, selection, sequences, vocabulary
from emberlog.operators.counters import Counters
from emberlog.operators.joins import joined
from emberlog.operators.places import placed


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_places_and_running_sums(spark):
    rng = random.Random(1)
    made = [(rng.choice(["a", "b", None, "c"]) if i % 3 else "a", rng.choice([None, 1, 2]), i, rng.choice([0, 1, 5, None])) for i in range(3000)]
    rows = spark.createDataFrame(made, "g string, o int, i long, s int").repartition(7)
    for within in (["g"], []):
        found = placed(rows, within, ["o", "i"], into="p", sums={"run": "s"}).collect()
        by = {}
        for g, o, i, s in sorted(made, key=lambda r: (r[1] is not None, r[1] or 0, r[2])):
            by.setdefault(g if within else 0, []).append((i, s or 0))
        want = {}
        for own in by.values():
            for p, (i, total) in enumerate(zip([i for i, _ in own], itertools.accumulate(s for _, s in own), strict=True)):
                want[i] = p, total
        assert {r.i: (r.p, r.run) for r in found} == want and len(found) == 3000


def test_places_of_nothing_and_of_falling_order(spark):
    assert placed(spark.createDataFrame([], "g string, i long"), ["g"], ["i"]).collect() == []
    found = placed(spark.range(50).repartition(5), [], ["id"], descending=["id"]).collect()
    assert {r.id: r.place for r in found} == {i: 49 - i for i in range(50)}


def test_blocks_compose_to_the_fold():
    rng = random.Random(2)
    for _ in range(400):
        n, most = rng.randint(0, 40), rng.choice([1, 3, 10, 25])
        sizes = [rng.choice([0, 0, 1, 2, 3, 5, 8, 30]) for _ in range(n)]
        cuts = [0, *sorted(rng.randint(0, n) for _ in range(rng.randint(0, 5))), n]
        whole = None
        for a, z in itertools.pairwise(cuts):
            part = chains.block_function(np.array(sizes[a:z], np.int64), most)
            whole = part if whole is None else chains.composed(whole, part)
        for fill in [*range(most + 3), most + 20]:
            _, after, begun = chains.forward(sizes, most, fill, 0)
            assert chains.applied(whole, fill) == (begun, after)


@pytest.mark.parametrize("block", [7, 65536])
def test_packing_equals_the_fold_in_groups_that_cross_tasks(spark, block):
    rng = random.Random(3)
    made = [(rng.choice(["hot", "hot", "hot", "a", None]), i, rng.choice([0, 1, 4, 9, 40, None])) for i in range(4000)]
    rows = spark.createDataFrame(made, "g string, i long, s int").repartition(6)
    found = sequences.packed(rows, ["g"], ["i"], "s", 30, block=block)
    got = {(r.g, r.i): r.chunk for r in found.collect()}
    want = {}
    for g in {m[0] for m in made}:
        own = [m for m in made if m[0] == g]
        want |= {(g, m[1]): c for m, c in zip(own, chains.forward([m[2] or 0 for m in own], 30, 0, 0)[0], strict=True)}
    assert got == want and found.count() == 4000 and found.columns == ["g", "i", "s", "chunk"]


def test_packing_a_group_of_many_rows_leaves_no_window(spark):
    rows = spark.range(300_000).select((F.col("id") * 7 % 100).cast("long").alias("s"), F.col("id").alias("i"))
    found = sequences.packed(rows, [], ["i"], "s", 2048)
    assert "Window" not in _plan(found) and "SinglePartition" not in _plan(found)
    sizes = [i * 7 % 100 for i in range(300_000)]
    assert found.agg(F.sum(F.col("chunk") * (F.col("i") % 1000))).first()[0] == sum(c * (i % 1000) for i, c in enumerate(chains.forward(sizes, 2048, 0, 0)[0]))


def test_packing_of_nothing(spark):
    assert sequences.packed(spark.createDataFrame([], "g string, i long, s int"), ["g"], ["i"], "s", 30).collect() == []


def test_heads_without_a_single_task(spark):
    made = [(f"w{i}", 1 + i * i % 37) for i in range(500)]
    vocab = spark.createDataFrame(made, "token string, n long")
    ranked = sorted((m for m in made if m[0] != "w3"), key=lambda m: (-m[1], m[0]))
    total = sum(n for _, n in made)
    found = vocabulary.head(vocab, percentile=0.4, ignored=["w3"])
    want, run = [], 0
    for i, (t, n) in enumerate(ranked):
        run += n
        if run <= total * 0.4:
            want.append((t, n, i + 1))
    assert sorted((r.token, r.n, r.rank) for r in found.collect()) == sorted(want)
    assert "Window" not in _plan(found)
    top = vocabulary.head(vocab, n=20, min_frequency=5).collect()
    assert {r.token for r in top} == {t for t, n in sorted(made, key=lambda m: (-m[1], m[0]))[:20] if n >= 5}


@pytest.mark.parametrize("bins", [4, 4096])
def test_selection_is_exact(spark, bins):
    rng = random.Random(4)
    groups = {"a": [rng.gauss(0, 1e6) for _ in range(999)], "b": [rng.choice([1.5, 2.0, 2.0, 1e300, -1e300]) for _ in range(400)], None: [3.25], "inf": [float("-inf"), 0.0, 1.0, float("inf")], "same": [7.0] * 50}
    made = [(g, v) for g, vs in groups.items() for v in vs] + [("a", None), ("a", float("nan")), ("none", None)]
    rows = spark.createDataFrame(made, "g string, v double").repartition(5)
    ranks = {"first": F.lit(0), "mid": F.floor(F.col("n") / 2), "last": F.col("n") - 1}
    found = {(r["__g"], r.name): r.x for r in selection.selected(rows, "v", ranks, ["g"], bins).collect()}
    for g, vs in groups.items():
        own = sorted(vs)
        assert [found[g, k] for k in ("first", "mid", "last")] == [own[0], own[len(own) // 2], own[-1]]
    assert len(found) == 3 * len(groups)


def test_statistics_with_null_groups(spark):
    rng = random.Random(5)
    values = [float(rng.randint(0, 1000)) for _ in range(301)]
    rows = spark.createDataFrame([(None, v) for v in values] + [("x", None)], "g string, v double")
    stats = {r.g: r for r in vocabulary.length_stats(rows, "v", ["g"]).collect()}
    assert stats[None].median == statistics.median(values) and stats[None].n == 301 and stats["x"].median is None
    box = {r.g: r for r in vocabulary.box_stats(rows, "v", ["g"]).collect()}
    assert [box[None].q1, box[None].median, box[None].q3] == list(np.percentile(values, [25, 50, 75]))
    assert box[None].whisker_low == min(values) and box["x"].q1 is None and len(box) == 2
    whole = vocabulary.box_stats(rows, "v").collect()
    assert len(whole) == 1 and whole[0].median == statistics.median(values) and whole[0].outliers_low == 0


def test_ordered_fold_over_blocks(spark):
    rng = random.Random(6)
    for n, block in ((40, 3), (40, 4096), (1, 2), (25, 1)):
        sets = [{rng.choice([None, *range(4)]) for _ in range(rng.randint(1, 4))} for _ in range(n)]
        rows = spark.createDataFrame([(w, w, e) for w, s in enumerate(sets) for e in s], "w long, at long, e int")
        now = set()
        for s in sets:
            now = now & s if now else set(s)
        assert {r.e for r in events.common_events_in_order(rows, ["w"], ["at"], ["e"], block=block).collect()} == now


def test_counters_of_one_pass(spark):
    counters = Counters()
    rows = counters.watch(spark.range(100), "read")
    kept = counters.watch(rows.filter("id % 3 = 0"), "kept", rows=F.lit(1), even=F.col("id") % 2 == 0)
    kept.write.format("noop").mode("overwrite").save()
    assert counters.values() == {"read": {"rows": 100}, "kept": {"rows": 34, "even": 17}}
    with pytest.raises(ValueError):
        counters.watch(rows, "read")


def test_joins_keep_null_keys(spark):
    left = spark.createDataFrame([(None, 1), ("a", 2), ("b", 3)], "k string, v int")
    right = spark.createDataFrame([(None, 10), ("a", 20)], "k string, w int")
    assert sorted((r.v, r.w) for r in joined(left, right, "k").collect()) == [(1, 10), (2, 20)]
    assert [r.v for r in joined(left, right, ["k"], "left_anti").collect()] == [3]
    assert sorted(r.v for r in joined(left, right, ["k"], "left_semi").collect()) == [1, 2]
