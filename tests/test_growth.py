"""Queries whose driver memory, time or shuffles grew too fast."""

import datetime as dt

import __spark_entry__


def _rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_sessions_of_a_stream_pass_by_the_driver(spark, tmp_path):
    day = dt.datetime(2024, 1, 1)
    minutes = {1: [0, 59, 119, 120], 2: [5], None: [7]}
    rows = [(u, day + dt.timedelta(minutes=m), "view") for u, all_of in minutes.items() for m in all_of]
    spark.createDataFrame(rows, "user_id long, ts timestamp_ntz, event_type string").write.parquet(f"{tmp_path}/events.parquet")
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    for name, n in (("stream_sessions", 3), ("stream_counts", 1)):
        found = __spark_entry__.queries()[name](spark, str(tmp_path))
        # A table in memory has no files.
        assert found.inputFiles() and found.count() == n
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass") == before
    found = __spark_entry__.queries()["stream_sessions"](spark, str(tmp_path))
    hour = dt.timedelta(hours=1)
    assert {r.user_id: (r.start, r.end, r.n) for r in found.collect()} == {u: (day + dt.timedelta(minutes=m[0]), day + dt.timedelta(minutes=m[-1]) + hour, len(m)) for u, m in minutes.items()}


def test_log_lines_are_structured_once(spark, tmp_path):
    events = [(i, dt.datetime(2024, 1, 1, 0, 0, i), i % 2, "error" if i % 3 else "view") for i in range(40)]
    spark.createDataFrame(events, "event_id long, ts timestamp_ntz, user_id long, event_type string").write.parquet(f"{tmp_path}/events.parquet")
    for name in ("process_lines", "process_event_types"):
        found = __spark_entry__.queries()[name](spark, str(tmp_path))
        # What is read are tables that mining has written, with no line matched again.
        assert found.inputFiles() and not any("events.parquet" in f for f in found.inputFiles()), name
    assert found.count() == 2


def test_messages_reach_rows_also_without_broadcast(spark, monkeypatch):
    from emberlog.functions.patterns import MiningSettings, masks
    from emberlog.operators import templates

    rows = spark.createDataFrame([("a" if i % 2 else None, i, f"did {i % 7}" if i % 5 else None) for i in range(60)], "component string, pos long, message string")
    mine = lambda: _rows(templates.mine_templates(rows, MiningSettings(0.4, 4, masks("number"))).withColumn("parameters", templates.F.to_json("parameters")))
    few = mine()
    monkeypatch.setattr(templates, "BROADCAST_CHARACTERS", -1)
    key = lambda r: tuple(map(str, r))
    assert sorted(map(key, few)) == sorted(map(key, mine())) and len(few) == 60


def test_formats_tell_which_characters_all_lines_have(spark):
    import re

    from emberlog.operators.structuring import parse
    from emberlog.sources.formats import compile_format

    assert compile_format("hadoop").needed == set(":[]")
    for log_format in ("<A>|<B>: x", "(?i)<A>:", "<A>(: )?<B>", "<A>-{0,2}<B>", "<A>:? <B>", "<Level|INFO|a:b> <B>", "[:;] <A>"):
        assert not compile_format(log_format).needed, log_format
    lines = ["a b c [d] e: f", "a b c d] e: f", "a b c [d] e f", "", None, "a\u0001 b c [d] e: f", "  at x.y(z:1)"]
    fmt = compile_format("hadoop")
    found = parse(spark.createDataFrame([(x,) for x in lines], "line string"), fmt).collect()
    pattern = re.compile(fmt.pattern.removeprefix("(?Ud)"))
    assert [r.is_valid for r in found] == [bool(x and pattern.search(x)) for x in lines]


def test_documents_are_scored_where_they_are(spark):
    import random

    from pyspark.sql import functions as F

    from emberlog.operators import masking

    r = random.Random(3)
    docs = [(i, [None if r.random() < 0.1 else [r.choice("abcdefg") if r.random() < 0.9 else None for _ in range(r.choice([0, 1, 5, 9]))] for _ in range(r.randint(0, 6))]) for i in range(40)] + [(99, None)]
    df = spark.createDataFrame(docs, "id long, s array<array<string>>")
    found = masking.document_scores(df.repartition(3), "id", "s")
    assert "Exchange hashpartitioning" not in found._jdf.queryExecution().executedPlan().toString()
    rows = df.select("id", F.posexplode("s").alias("at", "words")).withColumn("words", F.coalesce("words", F.array().cast("array<string>")))
    assert _rows(found) == _rows(masking.independent_scores(rows, "id", "at", "words"))


def test_spans_of_long_documents_take_a_step_each():
    import time

    from emberlog.operators.masking import PRESETS, TextInfilling

    document = [["w"] * 10 for _ in range(20_000)]
    began = time.process_time()
    masked = PRESETS["text-infilling"](seed=4).mask(document)
    # Scanning what is left for each span took minutes.
    assert time.process_time() - began < 20
    hidden = 200_000 - sum(t == "w" for s in masked for t in s)
    assert hidden <= 60_000 and len(masked) == 20_000
    assert TextInfilling(1.0, seed=2).mask([["a", "b"], []])[1] == []


def test_rounds_of_long_documents_add_up_arrays():
    import random
    import time

    from emberlog.operators.masking import GapSentences

    r = random.Random(5)
    document = [[f"w{int(r.expovariate(0.01))}" for _ in range(10)] for _ in range(1_500)]
    began = time.process_time()
    gap = GapSentences(0.3, "sequential")
    masked, shown = gap.both(document)
    assert time.process_time() - began < 8
    assert sum(s == ["<*>"] for s in masked) == len(shown) == 450
    small = [s[:4] for s in document[:12]] + [[]]
    assert gap.chosen(small) == GapSentences(0.3, "sequential", score=__import__("emberlog.operators.masking", fromlist=["x"]).unigram_f1).chosen(small)
