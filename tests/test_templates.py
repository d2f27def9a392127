"""Template mining, parameters, simplification, cleaning."""

import random

import pytest
from pyspark.sql import functions as F

from emberlog.functions.patterns import PATTERNS, PRESETS, MiningSettings, masks
from emberlog.operators import cleaning, templates

# Messages and the clusters that they form at similarity 0.1 and depth 3.
MESSAGES = [
    "Application #0 (root) started.",
    "Application #100 (NetworkManager) started.",
    "Interface eth0 up",
    "Interface wlan0 up",
    "Application #368 started.",
    "Application #1029 started.",
    "This is peer 10. Starting now.",
    "3 known devices found, 1 unknown device detected.",
    "Operation (join_overlay_network): STARTED",
    "Attepting connection with 127.0.0.1...",
    "Successfully connected to peer 8.",
    "Attepting connection with www.exampe.com...",
    "Successfully connected to peer 3.",
    "Operation (join_overlay_network): SUCCESS",
    "upload request received.",
    "Memory low. (276MiB remaining)",
    "Memory low. (132MiB remaining)",
    "Memory CRITICALLY low. (13MiB remaining)",
]
CLUSTERS = [[0, 1], [2, 3], [4, 5], [6], [7], [8, 13], [9, 11], [10, 12], [14], [15, 16], [17]]


def test_clusters_and_round_trip():
    found, names = templates.mine_messages(MESSAGES, MiningSettings(0.1, 3))
    by = {}
    for i, (event, _) in enumerate(found):
        by.setdefault(event, []).append(i)
    assert sorted(by.values()) == CLUSTERS
    for message, (event, parameters) in zip(MESSAGES, found, strict=True):
        values = iter(v for v, _ in parameters)
        assert "".join(next(values) if i % 2 else p for i, p in enumerate(templates._PLACE.sub("\0*\0", names[event]).split("\0"))) == message


def test_masked_parameters_keep_their_names():
    settings = MiningSettings(0.4, 4, masks("http_url", "number"))
    found, names = templates.mine_messages(["get http://a.b/c in 12 ms", "get http://d.e/f in 7 ms"], settings)
    assert names == {1: "get <http_url> in <number> ms"}
    assert found[0] == (1, [("http://a.b/c", "http_url"), ("12", "number")])


def test_columns_mine_and_rebuild(spark):
    rows = spark.createDataFrame([("a", i, m) for i, m in enumerate(MESSAGES)], "component string, pos long, message string")
    mined = templates.mine_templates(rows, MiningSettings(0.1, 3))
    rebuilt = mined.select("message", templates.reconstruct(F.col("template"), F.transform("parameters", lambda p: p["value"])).alias("again"))
    assert rebuilt.filter("message <> again").count() == 0
    assert mined.agg(F.min("event")).first()[0] == 1


def test_groups_give_what_one_tree_gives(spark):
    """Clusters of each component, mined in groups by tokens, against one tree over all messages of a component."""
    rng = random.Random(6)
    words = ["open", "close", "file", "7", "12", "0x1f", "x=3", "user", "failed"]
    made = [(rng.choice(["a", "b", "", None]), i, " ".join(rng.choice(words) for _ in range(rng.randint(0, 6)))) for i in range(600)]
    settings = MiningSettings(0.4, 5, masks("hex_number", "number"))
    rows = spark.createDataFrame(made, "component string, pos long, message string")
    mined = templates.mine_templates(rows.repartition(5), settings)
    found = {r["pos"]: (r["event"], r["template"], [(p["value"], p["mask"]) for p in r["parameters"]]) for r in mined.collect()}
    for component in ("a", "b", "", None):
        own = [x for x in made if x[0] == component]
        events, names = templates.mine_messages([m for _, _, m in own], settings)
        assert [found[i] for _, i, _ in own] == [(e, names[e], p) for e, p in events]
    assert len(found) == 600


def test_distinct_mining_rebuilds(spark):
    rows = spark.createDataFrame([("a", i, m) for i, m in enumerate(MESSAGES * 3)], "component string, pos long, message string")
    mined = templates.mine_distinct(rows, MiningSettings(0.1, 3))
    rebuilt = mined.select("message", templates.reconstruct(F.col("template"), F.transform("parameters", lambda p: p["value"])).alias("again"))
    assert rebuilt.count() == 3 * len(MESSAGES) and rebuilt.filter("message <> again").count() == 0


def test_rows_without_a_component_or_message_stay(spark):
    rows = spark.createDataFrame([(None, 1, "x 1"), (None, 2, "x 2"), ("a", 3, None), ("a", 4, "y")], "component string, pos long, message string")
    for mine in (templates.mine_templates, templates.mine_distinct):
        assert sorted(r["pos"] for r in mine(rows, MiningSettings()).collect()) == [1, 2, 3, 4]


def _made(n, seed):
    rng = random.Random(seed)
    kinds = ["open file * of user *", "close file *", "user * logged in from *", "job * failed after * s", "disk * at * percent of *", "started"]
    return [("", i, " ".join(str(rng.randint(0, 999)) if w == "*" else w for w in rng.choice(kinds).split())) for i in range(n)]


def test_trees_of_runs_merge_to_the_clusters_of_one_tree(spark):
    made = _made(3000, 8)
    rows = spark.createDataFrame(made, "component string, pos long, message string").repartition(6)
    settings = MiningSettings(0.4, 4)
    events, names = templates.mine_messages([m for _, _, m in made], settings)
    want = [(e, names[e]) for e, _ in events]
    for chunk_rows, fan, match_rows in ((100, 4, 5), (37, 2, 1000)):
        mined = {r["pos"]: (r["event"], r["template"]) for r in templates.mine_templates(rows, settings, chunk_rows=chunk_rows, fan=fan, match_rows=match_rows).collect()}
        assert [mined[i] for i in range(3000)] == want


def test_runs_of_few_messages_still_rebuild(spark):
    """At a similarity of 0.1 runs of five messages may cluster in another way, but templates hold their messages."""
    rows = spark.createDataFrame([("", i, m) for i, m in enumerate(MESSAGES)], "component string, pos long, message string").repartition(4)
    mined = templates.mine_templates(rows, MiningSettings(0.1, 3), chunk_rows=5, fan=2)
    rebuilt = mined.select("message", templates.reconstruct(F.col("template"), F.transform("parameters", lambda p: p["value"])).alias("again"))
    assert rebuilt.count() == len(MESSAGES) and rebuilt.filter("message <> again").count() == 0


def test_messages_passed_over_change_nothing():
    made = [m for _, _, m in _made(400, 9)] + ["<*> <*> x", "<*> <*> x"]
    rng = random.Random(10)
    rng.shuffle(made)
    one, all_ = templates.TemplateTree(0.5, 4), templates.TemplateTree(0.5, 4)
    for m in made:
        one.learn(m)
    all_.learn_all(made)
    assert one.templates == all_.templates


def test_ids_start_anew_in_each_component(spark):
    rows = spark.createDataFrame([("a", 1, "x y"), ("b", 1, "p q"), ("b", 2, "r s t")], "component string, pos long, message string")
    ids = {(r["component"], r["event"]) for r in templates.mine_templates(rows, MiningSettings()).collect()}
    assert ids == {("a", 1), ("b", 1), ("b", 2)}


@pytest.mark.parametrize(
    "mask, value, expected",
    [
        ("java_identifier", "org.apache.hadoop.Client$1", "Client"),
        ("linux_path", "/var/log/app.log", "log-path"),
        ("linux_path", "/--/", "path"),
        ("http_url", "http://x/y", "http-URL"),
        ("content_or_condition_uri", "content://a", "content_or_condition-URI"),
        ("hex_number", "0xFF", "255"),
        ("hex_segment", "0186a1", "1"),
        ("hex_segment", "d41d8cd98f00b204e9800998ecf8427e", hex(0xD41D8CD98F00B204E9800998ECF8427E % 100_000)[2:]),
        ("hex_number", "0xFEDCBA9876543210FEDC", str(0xFEDCBA9876543210FEDC)),
        ("hex_number", "0x7FFFFFFFFFFFFFFF1234567890ABCDE", str(0x7FFFFFFFFFFFFFFF1234567890ABCDE)),
        ("long_numerical_list", "1 2 2 3 3 3 4", "3, 2, 1"),
        ("number_with_unit", "5ms", "5ms"),
        ("*", "42", "42"),
        ("*", "1.5", "1.5"),
        ("*", "(a: longer! x)", "longer!"),
        ("@", "###", ""),
    ],
)
def test_simplified(spark, mask, value, expected):
    row = spark.createDataFrame([(value, mask)], "v string, m string").select(templates.simplified(F.col("v"), F.col("m")).alias("s")).first()
    assert row["s"] == expected


def test_hashed_parameters_are_stable(spark):
    row = spark.createDataFrame([("x",)], "v string").select(templates.simplified(F.col("v"), F.lit("block_id")).alias("b"), templates.simplified(F.col("v"), F.lit("ipv4_address_with_port")).alias("h")).first()
    assert row["b"] == "block#75009" and row["h"] == "remote host #75009"


def test_presets_are_complete():
    assert len(PRESETS) == 17 and len(PATTERNS) >= 20
    assert all(0 < p.similarity < 1 and p.depth >= 3 for p in PRESETS.values())


def test_cleaning(spark):
    rows = spark.createDataFrame([("failed\n at org.a.B.run(B.java:12)  ... 3 more", "org.apache.hadoop.ipc.Client")], "Message string, Component string")
    row = cleaning.clean(rows, "hadoop").first()
    assert row["Message"] == "failed" and row["Component"].startswith("#") and row["Component"].endswith(".ipc.Client") and len(row["Component"]) == len("#00000.ipc.Client")
    chip = " : ".join(["0a"] * 12)
    joined = cleaning.clean(spark.createDataFrame([(f"chip {chip} at 10.0.0.1 : 80",)], "Message string"), "summary_bgl").first()["Message"]
    assert joined == f"chip {'0a' * 12} at 10.0.0.1:80"
    times = cleaning.clean(spark.createDataFrame([("lifetime 00 : 01 : 02",)], "Message string"), "summary_proxifier").first()["Message"]
    assert times == "lifetime 00:01:02"


def test_timestamps(spark):
    rows = spark.createDataFrame([("02-29", "01:02:03.500"), ("13-01", "00:00:00.000")], "Date string, Time string")
    out = cleaning.timestamped(rows, "MM-dd HH:mm:ss.SSS", F.lit(2020)).collect()
    assert str(out[0]["Timestamp"]) == "2020-02-29 01:02:03.500000" and out[1]["Timestamp"] is None
