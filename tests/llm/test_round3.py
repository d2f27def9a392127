"""Repair, encoding and neighbour votes against brute force; faults of earlier operators that stay mended."""

import hashlib
import itertools
import random
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from emberlog.llm import encoding, html_text, minhash, neighbours, quality, repair, shards
from emberlog.llm.queries import damaged


# --- op11 ---------------------------------------------------------------------------------------------------------------------


def _plain_repair(turns):
    """All edits of a conversation by exhaustive search over states, turn by turn: cost, audit, repaired rows."""
    step = {0: 2, 1: 2, 2: 3, 3: 2}
    keeps = {("s", 0): 1, ("u", 0): 2, ("u", 1): 2, ("u", 3): 2, ("a", 2): 3}
    names = {2: "user", 3: "assistant"}

    def inserted(ways):
        out = dict(ways)
        for _ in range(3):
            for state, (c, a, rows) in list(out.items()):
                to = step[state]
                new = (c + 3, a + "I", [*rows, (names[to], "")])
                if to not in out or new[:2] < out[to][:2]:
                    out[to] = new
        return out

    ways, seen = inserted({0: (0, "", [])}), set()
    counts = dict.fromkeys(("blank", "duplicate", "truncated", "illegal"), 0)
    before = None
    for _, role, text in turns:
        bare = text.rstrip(" \t\n\x0b\x0c\r")
        fault = "blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else ""
        seen.add((role, text))
        if fault:
            counts[fault] += 1
        counts["illegal"] += before is not None and before + role[:1] not in ("su", "ua", "au")
        before = role[:1]
        new = {}

        def offer(state, way):
            if state not in new or way[:2] < new[state][:2]:
                new[state] = way

        for state, (c, a, rows) in ways.items():
            offer(state, (c + 4, a + "D", rows))
            if fault not in ("blank", "duplicate"):
                extra = 3 * (fault == "truncated")
                offer(step[state], (c + 3 + extra, a + "R", [*rows, (names[step[state]], text)]))
                if (role[:1], state) in keeps:
                    offer(keeps[role[:1], state], (c + extra, a + "K", [*rows, (role, text)]))
        ways = inserted(new)
    cost, audit, rows = min((ways[s] for s in (0, 3) if s in ways), key=lambda w: w[:2])
    numbers = [t for t, _, _ in turns if t is not None]
    gaps = max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0
    return gaps, counts, cost, audit, rows


def _conversations(n, longest, seed):
    rng = random.Random(seed)
    texts = ["Yes.", "No!", "what?", "cut off", "", " \t", "a b c.", None]
    for conv in range(n):
        turns = [(rng.choice([None, *range(12)]) if rng.random() < 0.3 else i, rng.choice(["user", "assistant", "user", "assistant", "system", "tool", None, "unknown"]), rng.choice(texts)) for i in range(rng.randint(0, longest))]
        yield (None if conv == 0 else conv), turns


@pytest.mark.parametrize("partitions", [1, 40])
def test_repair_equals_a_plain_search(spark, partitions):
    made = [(c, t, r, x) for c, turns in _conversations(60, 9, 1) for t, r, x in turns]
    long_rng = random.Random(2)
    made += [(10_000, i, long_rng.choice(["user", "assistant", "system"]), long_rng.choice(["One.", "two", "", f"n {i}."])) for i in range(400)]
    rows = spark.createDataFrame(made, "conv_id long, turn long, role string, text string")
    before = spark.conf.get("spark.sql.shuffle.partitions"), spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", str(partitions))
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        found = repair.audits(rows)
        got = {r.conv_id: r for r in repair.digests(rows, found).collect()}
        texts = defaultdict(list)
        for r in repair.replayed(rows, found).collect():
            texts[r.conv_id].append((r.place, r.role, r.text))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before[0])
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before[1])
    by = defaultdict(list)
    for c, t, r, x in made:
        by[c].append((t, r if r is not None else " ", x if x is not None else " "))
    assert set(got) == set(by)
    for c, turns in by.items():
        turns.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.sha256(r[2].encode()).hexdigest()))
        gaps, counts, cost, audit, rows_ = _plain_repair(turns)
        r = got[c]
        assert (r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit) == (gaps, counts["blank"], counts["duplicate"], counts["truncated"], counts["illegal"], cost, audit)
        assert r.repaired_sha256 == hashlib.sha256("\n".join(f"{a}:{b}" for a, b in rows_).encode()).hexdigest()
        assert [(a, b) for _, a, b in sorted(texts[c])] == rows_


def test_products_are_associative():
    rng = random.Random(3)
    kinds = list(repair._TURNS.values())
    for _ in range(300):
        a, b, c = (repair.times(rng.choice(kinds), rng.choice(kinds)) for _ in range(3))
        assert repair.times(repair.times(a, b), c) == repair.times(a, repair.times(b, c))
        assert repair.times(repair.IDENTITY, a) == a == repair.times(a, repair.IDENTITY)


def test_repair_of_nothing_gone_and_clashing_columns(spark):
    empty = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert repair.digests(empty, repair.audits(empty)).collect() == []
    rows = spark.createDataFrame([(5, 0, "user", "x.", True, "m"), (6, 0, "user", "x.", False, "m"), (6, 0, "user", "x.", False, "m"), (6, 1, "assistant", "y" * 100_000, False, "m")], "conv_id long, turn long, role string, text string, gone boolean, conv string")
    found = {r.conv_id: r for r in repair.digests(rows, repair.audits(rows, gone="gone"), gone="gone").collect()}
    assert (found[5].cost, found[5].audit, found[5].repaired_sha256) == (0, "", hashlib.sha256(b"").hexdigest())
    # The truncated answer goes for an empty one, or stays, at 3 more.
    assert (found[6].duplicate, found[6].truncated, found[6].cost, found[6].audit) == (1, 1, 7, "KDK")


def test_damage_is_as_stated(spark):
    made = [(c, t, "assistant", "Hi. You!") for c in range(40) for t in range(3)] + [(None, None, None, None)]
    rows = damaged(spark.createDataFrame(made, "conv_id long, turn long, role string, text string")).collect()
    kinds = {(c, t): zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20 for c, t, _, _ in made}
    for (c, t), d in kinds.items():
        own = [r for r in rows if (r.conv_id, r.turn) == (c, t)]
        assert len(own) == 1 + (d == 3) and own[0].gone == (d == 0)
        text = " " if c is None else "Hi. You!"
        assert own[0].text == ("" if d == 1 else "Hi You" if d == 2 and c is not None else text)
        assert own[0].role == ("user" if d == 4 else " " if c is None else "assistant")


# --- op12 ---------------------------------------------------------------------------------------------------------------------


def _plain_history(rows, column, gap):
    """n and s of each row by comparing all pairs."""
    return [tuple(sum(q[k] for q in rows if q[column] == r[column] and q["fold"] != r["fold"] and q["tm"] + gap < r["tm"]) for k in ("n", "s")) for r in rows]


@pytest.mark.parametrize("gap", [0, 7])
@pytest.mark.parametrize("shard_points", [5, 16_384])
def test_histories_equal_all_pairs(spark, monkeypatch, gap, shard_points):
    rng = random.Random(gap + shard_points)
    made = [{"i": i, "x": rng.choice(["hot"] * 5 + ["a", "b", None]), "tm": rng.randint(0, 60), "fold": rng.randint(0, 4), "n": rng.randint(1, 3), "s": rng.randint(0, 1)} for i in range(400)]
    rows = spark.createDataFrame([tuple(r.values()) for r in made], "i long, x string, tm long, fold int, n long, s long").repartition(5)
    found = encoding.encode(rows, [["x"]], folds=5, gap=gap, shard_points=shard_points, share=1.0).collect()
    want = _plain_history(made, "x", gap)
    assert len(found) == 400
    for r in found:
        n, s = want[r.i]
        assert (r.x_n, r.x_rate) == (n, 500_000 if n < 1 else (1_000_000 * s + 50 * 500_000) // (n + 50))


def test_chunks_carry_balances():
    """Chunks far smaller than a shard give what one chunk gives."""
    rng = random.Random(5)
    rows = sorted(((rng.choice("ab"), rng.randint(0, 1), rng.randint(0, 40), f) for f in range(5) for _ in range(60)), key=lambda r: r[:3])
    table = pa.table({"v": [r[0] for r in rows], "part": [r[1] for r in rows], "tm": [r[2] for r in rows], "fold": pa.array([r[3] for r in rows], pa.int32()), "n": [1] * len(rows), "s": [i % 2 for i in range(len(rows))], "asks": [True] * len(rows)})
    out = []
    for size in (10_000, 12):
        encoding.CHUNK_POINTS, before = size, encoding.CHUNK_POINTS
        try:
            out.append(pa.Table.from_batches(list(encoding._sharded(5)(iter(table.to_batches(max_chunksize=7))))).to_pylist())
        finally:
            encoding.CHUNK_POINTS = before
    assert out[0] == out[1] and len(out[0]) == len(rows)


def test_sales_with_odd_rows(spark):
    import datetime

    at = lambda d: datetime.datetime(2024, 1, d)
    lines = spark.createDataFrame([(1, None, 7, "returned"), (1, None, 7, None), (2, 5, None, "returned"), (3, 5, 7, "kept"), (9, 5, 7, "kept"), (None, 5, 7, "kept"), (4, 5, 7, "returned")], "sale_id long, item_id long, vendor_id long, flag string")
    sales = spark.createDataFrame([(1, None, at(1)), (2, 3, at(2)), (2, 3, at(9)), (3, 3, at(3)), (4, 3, None)], "sale_id long, client_id long, sold_at timestamp_ntz")
    items = spark.createDataFrame([(5, "k"), (5, "z")], "item_id long, kind string")
    vendors = spark.createDataFrame([], "vendor_id long, nation_id long")
    clients = spark.createDataFrame([(3, None)], "client_id long, segment string")
    found = {(r.sale_id, r.item_id, r.vendor_id): r for r in encoding.sales_rates(lines, sales, items, vendors, clients).collect()}
    assert set(found) == {(1, -1, 7), (2, 5, -1), (3, 5, 7)}
    assert (found[1, -1, 7].n_lines, found[1, -1, 7].n_returned, found[1, -1, 7].item_rate) == (2, 1, 500_000)
    fold = lambda i: zlib.crc32(str(i).encode()) % 5
    assert found[3, 5, 7].item_n == (fold(2) != fold(3)) and found[3, 5, 7].vendor_n == 2 * (fold(1) != fold(3))
    nothing = lines.limit(0)
    assert encoding.sales_rates(nothing, sales, items, vendors, clients).collect() == []


# --- op13 ---------------------------------------------------------------------------------------------------------------------

WORDS = [f"{a}{b}{c}" for a in "bcdfglmnprst" for b in "aeiou" for c in ("n", "rt", "sk", "ll")]


def _text(rng, good):
    words = [rng.choice(WORDS) for _ in range(rng.randint(40, 120))]
    if good:
        return ". ".join(" ".join(words[i : i + 9]).capitalize() for i in range(0, len(words), 9)) + "."
    kind = rng.randrange(3)
    return " ".join(w + "###" for w in words) if kind == 0 else " | ".join(words).upper() if kind == 1 else " ".join([words[0]] * 80)


def test_scores_on_held_out_rows(spark, docs_of):
    rng = random.Random(6)
    labels = [int(rng.random() < 0.7) for _ in range(900)]
    docs = docs_of([_text(rng, y) for y in labels])
    held = [zlib.crc32(str(i).encode()) % 4 == 2 for i in range(900)]
    known = spark.createDataFrame([(i, y) for i, y in enumerate(labels) if not held[i]] + [(None, 1), (3, None)], "doc_id long, quality int")
    model = neighbours.fit(docs, known)
    found = {r.doc_id: r for r in neighbours.score(docs, model, keep=["doc_id"]).collect()}
    assert len(found) == 900 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in found.values())
    right = [found[i].predicted == labels[i] for i in range(900) if held[i]]
    assert np.mean(right) > 0.97


def test_votes_equal_a_plain_search():
    rng = random.Random(7)
    texts = pa.array([_text(rng, i % 3) for i in range(60)] + [None, "", "  \n"])
    counts = neighbours.term_counts(texts)
    model = neighbours.fitted(counts[:40], np.array([i % 2 for i in range(40)]))
    got = neighbours.votes(counts, model, 5)
    for row, score in zip(counts, got, strict=True):
        point = ((neighbours._parts(row[None]) * model.weights) @ model.axes)[0]
        point = point / max(np.linalg.norm(point), 1e-12)
        near = sorted(((-round(float(np.float64(point @ v)), 5), i) for i, v in enumerate(model.vectors)))[:5]
        weights = [max(-s, 1e-6) ** neighbours.POWER for s, _ in near]
        want = sum(w * float(model.labels[i]) for w, (_, i) in zip(weights, near, strict=True)) / sum(weights)
        assert abs(want - score) < 0.02
    assert (counts[60:].argmax(axis=1) == 0).all()


def test_term_counts_equal_a_plain_count():
    text = "Ab ab! ab! Ab 12 x"
    row = neighbours.term_counts(pa.array([text]))[0]
    assert row[neighbours._SAME] == 1 and row[neighbours._SEEN] == 1 and row[neighbours._FRESH] == 4
    assert row[neighbours._MARKS : neighbours._MARKS + neighbours._SHAPES].sum() == 6 and row[neighbours._MARKS + neighbours._SHAPES :].sum() == 5
    assert row[neighbours._MARKS + zlib.crc32(b"Aa") % neighbours._SHAPES] >= 2


def test_scores_of_odd_tables(spark, docs_of):
    empty = docs_of([]).select("doc_id", "text")
    none = spark.createDataFrame([], "doc_id long, quality int")
    model = neighbours.fit(docs_of(["a"]), none)
    assert neighbours.score(empty, model).collect() == []
    odd = spark.createDataFrame([(1, "x", 9.0), (1, "x", 9.0), (None, None, 9.0), (2, "word " * 400_000, 9.0)], "doc_id long, text string, score double")
    assert [r.score for r in neighbours.score(odd, model).collect()] == [0.5] * 4
    model = neighbours.fit(docs_of(["a b c. " * 20, "### ###"]), spark.createDataFrame([(0, 1), (1, 0)], "doc_id long, quality int"))
    found = neighbours.score(odd, model)
    assert found.columns == ["doc_id", "text", "score", "predicted"] and found.count() == 4


# --- earlier operators --------------------------------------------------------------------------------------------------------


def _page(spark, html):
    return html_text.extract(spark.createDataFrame([(1, html)], "page_id long, html string"), html="html", into="text").first()["text"]


@pytest.mark.parametrize(
    "html, text",
    [
        ("<p>one</p><script src=/js/>var leaked=1;</script><p>two</p>", "one two"),
        ('<p>one</p><script src="x"/>var leaked=1;</script><p>two</p>', "one two"),
        ("<p>one</p><style media=x/>p{}</style><p>two</p>", "one two"),
        ("<p>one</p><button class=x/>push</button><p>two</p>", "one two"),
        ("<p>one</p><svg width=1 /><p>two</p>", "one two"),
        ("<p>a<!-->b</p><p>c</p>", "ab c"),
        ("<p>a<!--->b</p><p>c</p>", "ab c"),
        ("<p>a<!-- x --!>b</p><p>c</p>", "ab c"),
        ("<p>a<!-- x > y -->b</p><p>c</p>", "ab c"),
        ("<p>a<a href=/x/>b</a> c</p>", "ab c"),
    ],
)
def test_slashes_and_comments(spark, html, text):
    assert _page(spark, html) == text


def test_buckets_on_two_levels(spark, docs_of):
    docs = docs_of([f"text {i} " + "x" * (i % 50) for i in range(3000)]).repartition(5)
    one = shards.external_shuffle(docs, shards=4, buckets=30)
    two = shards.external_shuffle(docs, shards=4, buckets=30, most=16)
    rows = two.collect()
    assert len(rows) == 3000 and {r.doc_id for r in rows} == set(range(3000))
    for s in range(4):
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(sum(r.shard == s for r in rows)))
    assert max(two.groupBy("shard", "bucket").count().toPandas()["count"]) < 80
    assert {(r.doc_id, r.shard) for r in rows} == {(r.doc_id, r.shard) for r in one.collect()}


def test_samples_come_from_all_partitions(spark):
    rows = spark.range(8000).select(F.concat(F.lit("text "), F.col("id")).alias("text")).repartitionByRange(8, "text")
    parts = rows.withColumn("p", F.spark_partition_id()).groupBy("text").agg(F.first("p").alias("p"))
    drawn = quality.sampled(rows).join(parts, "text").groupBy("p").count().collect()
    assert len(drawn) == 8 and sum(r["count"] for r in drawn) == quality.SAMPLE_ROWS


def test_sets_that_share_an_id_keep_one_row_each(spark, docs_of, monkeypatch):
    """With one id forced on all sets (checks differ), rows neither multiply nor go."""
    node = minhash._node
    rng = random.Random(8)
    docs = docs_of([" ".join(rng.choice(WORDS) for _ in range(60)) for _ in range(3)])
    signed = minhash._signed

    def forced(k):
        run = signed(k)

        def same(batches):
            for b in run(batches):
                at = b.schema.get_field_index("id")
                yield pa.RecordBatch.from_arrays([pa.array(np.full(b.num_rows, 5)) if i == at else c for i, c in enumerate(b.columns)], b.schema.names)

        return same

    monkeypatch.setattr(minhash, "_signed", forced)
    assert node is minhash._node
    assert sorted(r.doc_id for r in minhash.near_duplicates(docs).collect()) == [0, 1, 2]


def test_runs_merge_in_any_grouping():
    rng = random.Random(9)
    turns = [(False, rng.choice([None, 1, 2, 3]), rng.choice(["user", "assistant", "system"]), rng.choice("abc"), False, False, rng.random() < 0.3) for _ in range(30)]
    turns.sort(key=lambda r: (r[1] is not None, r[1] or 0, r[2], r[3]))
    whole = repair._run_of(turns)
    for _ in range(20):
        cuts = [0, *sorted(rng.sample(range(1, 30), 4)), 30]
        # A repeat right after a cut is told by the join over the whole conversation, so cuts lie between different turns.
        cuts = [c for c in cuts if c in (0, 30) or turns[c][1:4] != turns[c - 1][1:4]]
        parts = [repair._run_of(turns[a:z]) for a, z in itertools.pairwise(cuts)]
        merged = parts[0]
        for p in parts[1:]:
            merged = merged.then(p)
        assert merged.values() == whole.values()
