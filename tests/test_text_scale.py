"""Longest common subsequences by bits, gap sentences of any order, trees in order, and streams with state, against plain Python."""

import random
import time
import tracemalloc

import pytest
from pyspark.sql import functions as F

from emberlog.operators import masking, metrics, structuring, traces
from emberlog.operators.counters import StreamCounters, watch_stream
from emberlog.streaming import continuation


def _table(a, b):
    t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            t[i + 1][j + 1] = t[i][j] + 1 if x == y else max(t[i][j + 1], t[i + 1][j])
    return t


def _places(a, b):
    t, i, j, found = _table(a, b), len(a), len(b), set()
    while i and j:
        if a[i - 1] == b[j - 1]:
            found.add(i - 1)
            i, j = i - 1, j - 1
        elif t[i - 1][j] >= t[i][j - 1]:
            i -= 1
        else:
            j -= 1
    return found


def test_common_subsequences_by_bits():
    rng = random.Random(1)
    for _ in range(400):
        a, b = ([rng.choice("abcd") for _ in range(rng.randint(0, 30))] for _ in range(2))
        assert metrics.lcs_length(a, b) == _table(a, b)[-1][-1]
        assert metrics._lcs_places(a, b) == _places(a, b)


def test_long_texts_take_little_time_and_memory():
    rng = random.Random(2)
    a, b = ([rng.randint(0, 500) for _ in range(20_000)] for _ in range(2))
    began = time.process_time()
    length = metrics.lcs_length(a, b)
    assert time.process_time() - began < 3
    tracemalloc.start()
    places = metrics._lcs_places(a, b)
    assert tracemalloc.get_traced_memory()[1] < 50 << 20
    tracemalloc.stop()
    assert len(places) == length


def _meteor(prediction, reference):
    taken, used = {}, set()
    for form in (str, metrics.stem):
        for i, w in enumerate(prediction):
            if i not in taken:
                for j, r in enumerate(reference):
                    if j not in used and form(w) == form(r):
                        taken[i] = j
                        used.add(j)
                        break
    return taken


def test_meteor_matches_the_first_free_word():
    rng = random.Random(3)
    words = ["walk", "walks", "walking", "talk", "talked", "the", "a"]
    for _ in range(300):
        p, r = ([rng.choice(words) for _ in range(rng.randint(0, 12))] for _ in range(2))
        taken = _meteor(p, r)
        if not taken:
            assert metrics.meteor(p, r) == 0.0
            continue
        pr, rc = len(taken) / len(p), len(taken) / len(r)
        places = sorted(taken.items())
        chunks = 1 + sum(not (x[0] + 1 == y[0] and x[1] + 1 == y[1]) for x, y in zip(places, places[1:], strict=False))
        assert metrics.meteor(p, r) == pytest.approx(10 * pr * rc / (rc + 9 * pr) * (1 - 0.5 * (chunks / len(taken)) ** 3))


@pytest.mark.parametrize("n", [1, 2, 3])
@pytest.mark.parametrize("select", ["independent", "sequential"])
def test_gap_sentences_of_any_order_equal_the_slow_scorer(n, select):
    rng = random.Random(n)
    for _ in range(120):
        sentences = [[rng.choice("abcde") for _ in range(rng.choice([0, 1, 2, 3, 7]))] for _ in range(rng.randint(0, 9))]
        slow = masking.GapSentences(0.5, select, score=lambda a, b: masking.ngram_f1(a, b, n))
        assert masking.GapSentences(0.5, select, n=n).chosen(sentences) == slow.chosen(sentences)


def test_stemmed_gap_sentences():
    sentences = [["Walking", "dogs"], ["x", "y"], ["walks", "dog", "z"], ["q"]]
    assert masking.GapSentences(0.25, stems=True).chosen(sentences) == {0}
    stems = [[metrics.stem(t.lower()) for t in s] for s in sentences]
    for name in ("gap-independent", "gap-sequential"):
        assert masking.PRESETS[f"{name}-stems"]().chosen(sentences) == masking.PRESETS[name]().chosen(stems)


def test_trees_in_order(spark):
    rng = random.Random(4)
    made, want = [], {}
    for trace in ("t", None):
        children = {}
        for i in range(1, 120):
            children.setdefault(str(rng.randint(0, i - 1)), []).append(str(i))
        made += [(len(made), trace, p, c) for p, cs in children.items() for c in cs]
        order, stack = [], [("0", 0)]
        while stack:
            span, depth = stack.pop()
            order.append((span, depth))
            stack += [(c, depth + 1) for c in sorted(children.get(span, []), key=int, reverse=True)]
        want |= {(trace, s): (i, d) for i, (s, d) in enumerate(order)}
    rows = spark.createDataFrame(made, "pos long, trace string, parent string, span string").repartition(5)
    assert {(r.trace, r.span): (r.row, r.depth) for r in traces.in_tree_order(traces.forest(rows)).collect()} == want


FORMAT = "<Level|INFO>: <Message>"


def _lines(seed):
    rng = random.Random(seed)
    return [(f, i, f"INFO: m{i}" if i == 1 or rng.random() < 0.5 else f"  at {i}") for f in "abc" for i in range(1, 30)]


@pytest.fixture
def state_store(spark):
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, continuation.PROVIDER)
    yield
    spark.conf.set(name, before)


@pytest.mark.parametrize("cut, spread", [(13, 0), (29, 8)])
def test_continuation_over_any_cut_equals_the_batch(spark, state_store, tmp_path, cut, spread):
    rng = random.Random(cut)
    rows = _lines(5)
    kind = "file string, line_no long, line string"
    came = sorted(rows, key=lambda r: r[1] + rng.random() * spread)
    for k in range(0, len(came), cut):
        spark.createDataFrame(came[k : k + cut], kind).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    counters = StreamCounters()
    spark.streams.addListener(counters)
    name = f"got_{cut}"
    try:
        lines = watch_stream(spark.readStream.schema(kind).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in")), f"lines_{cut}", rows=F.lit(1))
        running = continuation.appended_stream(lines, FORMAT, "Message").writeStream.format("memory").queryName(name).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
        running.awaitTermination()
    finally:
        spark.streams.removeListener(counters)
    found = spark.table(name).unionByName(continuation.open_entries(spark, str(tmp_path / "state"), FORMAT, "Message"))
    want = structuring.structure(spark.createDataFrame(rows, kind), FORMAT, "append", append_to="Message")
    columns = ["file", "line_no", "Level", "Message"]
    assert sorted(map(tuple, found.select(columns).collect())) == sorted(map(tuple, want.select(columns).collect()))
    assert counters.values().get(f"lines_{cut}", {"rows": len(rows)}) == {"rows": len(rows)}


def test_idle_files_close_their_entry(spark, state_store, tmp_path):
    kind = "file string, line_no long, line string"
    spark.createDataFrame([("a", 1, "INFO: x"), ("a", 2, " y"), ("b", 1, "INFO: z")], kind).coalesce(1).write.parquet(str(tmp_path / "in"))
    lines = spark.readStream.schema(kind).parquet(str(tmp_path / "in"))
    running = continuation.appended_stream(lines, FORMAT, "Message", idle_ms=200).writeStream.format("memory").queryName("idle").option("checkpointLocation", str(tmp_path / "state")).trigger(processingTime="300 milliseconds").start()
    try:
        for _ in range(120):
            time.sleep(0.5)
            if spark.table("idle").count() == 2:
                break
        assert sorted(map(tuple, spark.table("idle").select("file", "line_no", "Message").collect())) == [("a", 1, "x\ny"), ("b", 1, "z")]
    finally:
        running.stop()


def test_a_stream_that_begins_with_a_continuation_fails(spark, state_store, tmp_path):
    kind = "file string, line_no long, line string"
    spark.createDataFrame([("a", 1, " y")], kind).coalesce(1).write.parquet(str(tmp_path / "in"))
    running = continuation.appended_stream(spark.readStream.schema(kind).parquet(str(tmp_path / "in")), FORMAT, "Message").writeStream.format("memory").queryName("broken").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    with pytest.raises(Exception, match="doesn't fit"):
        running.awaitTermination()


def test_shared_elements_by_one_sweep(spark):
    from collections import Counter

    rng = random.Random(11)
    made = [(i, [rng.choice(["", "a", "b", "c d"]) for _ in range(rng.randint(0, 9))], [rng.choice(["", "a", "b", "c d"]) for _ in range(rng.randint(0, 9))]) for i in range(200)]
    rows = spark.createDataFrame(made, "i int, a array<string>, b array<string>").select("i", metrics.shared_count(F.col("a"), F.col("b")).alias("n"))
    assert {r.i: r.n for r in rows.collect()} == {i: sum((Counter(a) & Counter(b)).values()) for i, a, b in made}
    pairs = spark.createDataFrame([(None, "the cat sat", "the cat"), (1, None, "x")], "k int, p string, r string")
    assert {r.k: (r.shared, r.predicted, r.referred) for r in metrics.shared_ngrams(pairs, "k", "p", "r", 2).collect()} == {None: (1, 2, 1), 1: (0, 0, 0)}
    assert "Exchange" not in metrics.rouge_n(pairs, "k", "p", "r")._jdf.queryExecution().executedPlan().toString()
