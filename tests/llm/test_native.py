"""Personal data, chat texts, shards, quality rules, licenses: against plain Python."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from emberlog.llm import boosting, chat, licenses, pii, quality, queries, shards

ODD = [None, "", " ", "\n\n", "a", "a b", "x" * 3000, "word " * 900, "éü你好 \U0001f642", "tab\tand nbsp", "\\### Assistant: </turn> ok"]

BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)",
    "card": r"[0-9](?:[\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def _luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c)
        total += d if i % 2 == 0 else d * 2 - 9 if d > 4 else d * 2
    return total % 10 == 0


def base_spans(text):
    out = []
    for kind, pattern in BASE.items():
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            if kind == "ip" and any(int(p) > 255 for p in m[0].split(".")):
                continue
            if kind == "card" and not (16 <= len(digits) <= 19 and _luhn(digits)):
                continue
            if kind == "phone" and not 8 <= len(digits) <= 15:
                continue
            out.append(f"{kind}:{m.start()}:{m.end()}")
    return out


def test_base_spans_and_redaction(spark, saved_docs):
    rng = random.Random(3)
    bits = ["a@b.co", "@", ".", "+", "1", "23", "4.5.6.7", "256.1.2.3", "4111 1111 1111 1111", "é", " ", "-", "(", "ü@x.y", "_x@d.ee", "+1 (22) 333-4444", "0000", "12-", "\U0001f642", "\n"]
    texts = ODD + ["".join(rng.choice(bits) for _ in range(rng.randint(0, 14))) for _ in range(400)] + ["a" * 50_000, "1" * 50_000, "+1 " * 10_000, "x@y.zz " * 2_000]
    path = saved_docs(texts)
    for r in queries.QUERIES["op1_boosted_pii"](spark, path).collect():
        expected = base_spans(texts[r.doc_id] or "")
        assert r.base_sha256 == hashlib.sha256(",".join(expected).encode()).hexdigest(), texts[r.doc_id]
        assert r.spans.split(",")[: len(expected)] == (expected or r.spans.split(",")[:0])
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(s.startswith(k + ":") for s in expected) for k in BASE]


def test_redaction_keeps_the_rest(spark, docs_of):
    docs = docs_of(['mail a@b.co or +1 (22) 333-4444, token = "0123456789abcdef0123456789abcdef".', None, "plain"])
    rows = {r.doc_id: r for r in pii.redact(docs).collect()}
    assert rows[0].text == "mail <EMAIL> or <PHONE>, <SECRET>." and rows[1].text is None and rows[2].text == "plain"
    assert pii.redact(docs.withColumn("base", F.lit("mine"))).first()["base"] == "mine"
    assert pii.redact(docs).columns == docs.columns and pii.redact(docs.limit(0)).count() == 0


def test_secrets_of_any_length(spark, docs_of):
    rng = random.Random(17)
    value = lambda n: "".join(rng.choice("0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ/+") for _ in range(n))
    texts = [
        f"so aws_session_token={value(356)} end",
        f"so aws_secret_access_key = {value(40)} end",
        f'so oauth2_token: "{value(40)}" end',
        f"so the_name_of_a_rather_long_application_token={value(5000)} end",
        "WRITE TO SOMEBODY [AT] EXAMPLE [DOT] COM END",
    ]
    texts.append("a_1" * 50_000 + "=" + "x" * 50_000 + " " + "ab_=" * 20_000)
    rows = {r.doc_id: r.text for r in pii.redact(docs_of(texts)).collect()}
    assert [rows[i] for i in range(4)] == ["so <SECRET> end"] * 4
    assert rows[4] == "WRITE TO <EMAIL_SPELLED> END"


@pytest.mark.parametrize("made", [lambda: pii.made_candidates(3000, seed=99), lambda: pii.other_candidates(3000, seed=98)])
def test_boosted_trees_hold_out(made):
    features, label, kind = pii.feature_table(made())  # other candidates than those of the training and the calibration
    model = pii.model()
    cuts = dict(model.cuts)
    taken, good = model.scores(features) >= np.array([cuts[k] for k in kind]), label > 0
    assert (taken & good).sum() / good.sum() > 0.95 and (taken & good).sum() / taken.sum() > 0.9
    assert len(set(cuts.values())) > 3 and set(cuts) == set(pii.LOOSE)


def test_boosting_splits():
    x = np.arange(200.0)
    model = boosting.train({"x": x}, (x > 120).astype(int))
    assert ((model.probability({"x": x}) > 0.5) == (x > 120)).mean() > 0.99


def test_calibration():
    rng = np.random.default_rng(5)
    x = rng.integers(0, 10, 4000).astype(float)
    label = (rng.random(4000) < x / 10).astype(int)
    scores, p = boosting.isotonic(x, label)
    assert scores.tolist() == list(range(10)) and (np.diff(p) >= 0).all() and np.abs(p - np.arange(10) / 10).max() < 0.06
    model = boosting.train({"x": x}, label)
    told = boosting.calibrated(model, {"x": x}, label, np.array(["a", "b"])[(x >= 0).astype(int)], {"b": 0.75, "a": 0.5})
    cuts = dict(told.cuts)
    assert cuts["a"] == float("inf") and ((model.scores({"x": x}) >= cuts["b"]) == (x >= 8)).all()


def _added(text, base):
    """Candidates, scores and sweep in plain Python."""
    model, found = pii.model(), []
    cuts = dict(model.cuts)
    for kind, pattern in pii.LOOSE.items():
        if kind in pii.LOOSE_SIGN and not re.search(pii.LOOSE_SIGN[kind], text):
            continue
        last = 0
        matches = list(re.finditer(pattern, text))
        for i, m in enumerate(matches):
            after = text[m.end() : matches[i + 1].start() if i + 1 < len(matches) else len(text)]
            numbers = pii._numbers(kind, m[0], text[last : m.start()][-pii.NEAR :], after[: pii.NEAR])
            last = m.end()
            score = float(model.scores({k: np.array([v]) for k, v in numbers.items()})[0])
            if score >= cuts[kind] and all(e <= m.start() or m.end() <= s for s, e in base):
                found.append((m.start(), m.end(), kind, score))
    out = []
    for x in sorted(found):
        if not out or x[0] >= out[-1][1]:
            out.append(x)
        elif x[3] > out[-1][3]:
            out[-1] = x
    return [f"{k}:{s}:{e}" for s, e, k, _ in out]


def test_added_spans(spark, saved_docs):
    rng = random.Random(31)
    made = [m for m in pii.made_candidates(600, seed=7) + pii.other_candidates(600, seed=8)]
    bits = [b + t + a for _, t, b, a, _ in made] + ["a@b.co", " 4.5.6.7 ", "+1 (22) 333-4444", "é", " ", "\n", "word", "🙂", "key=", "12:34:56:78:90 "]
    texts = ["".join(rng.choice(bits) + rng.choice(["", " "]) for _ in range(rng.randint(0, 12))) for _ in range(600)]
    n = 0
    for r in queries.QUERIES["op1_boosted_pii"](spark, saved_docs(texts)).collect():
        base = base_spans(texts[r.doc_id])
        places = [tuple(map(int, s.split(":")[1:])) for s in base]
        added = _added(texts[r.doc_id], places)
        n += len(added)
        assert r.spans == ",".join(base + added), texts[r.doc_id]
    assert n > 500


def test_many_spans_in_one_text(spark, docs_of):
    import time

    unit = "é mail a@b.co and 555-123-4567 call token: 0123456789abcdef0123456789abcdef so " + "word " * 25
    text = unit * 33_000  # 100,000 spans in 7 MB
    expected = "é mail <EMAIL> and <TEL> call token: 0123456789abcdef0123456789abcdef so "
    began = time.perf_counter()
    row = pii.redact(docs_of([text, "plain"])).filter("doc_id = 0").first()
    took = time.perf_counter() - began
    assert row.text.count("<EMAIL>") == 33_000 and took < 60, took
    assert row.text == row.text[: len(row.text) // 33_000] * 33_000, expected


def test_chat_round_trip(spark):
    texts = [t for t in ODD if t is not None] + ["#", "<", "\\", "\\b", "\\l\\h", "</turn>\n### user\nx"]
    rows = [(i % 3, i, ["user", "assistant", "odd\n#role"][i % 3], t) for i, t in enumerate(texts)] + [(5, 0, None, None), (5, 0, None, None), (None, 1, "user", "q")]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    out = chat.format_trees(chat.linear_threads(table)).select("root", "formatted", chat.parse(F.col("formatted")).alias("turns"), chat.under_mask(F.col("formatted"), F.col("mask")).alias("learned")).collect()
    assert len(out) == 5
    for r in out:
        conv = r.root.split(":")[0]
        mine = sorted([x for x in rows if str("" if x[0] is None else x[0]) == conv], key=lambda x: (x[1], x[2] or "", x[3] or ""))
        assert [(t.role, t.text) for t in r.turns] == [(x[2] or "", x[3] or "") for x in mine]
        assert r.learned == "".join(x[3] or "" for x in mine if x[2] == "assistant")


def test_branches_by_score(spark):
    rows = [("a", None, 1.0, "user", "hi"), ("b", "a", 0.1, "assistant", "bad"), ("c", "a", 0.9, "assistant", "good"), ("d", "c", 0.8, "user", "go on"), ("x", "y", 1.0, "user", "loop"), ("y", "x", 1.0, "user", "loop"), ("z", "gone", 1.0, "user", "alone")]
    table = spark.createDataFrame(rows, "id string, parent string, score double, role string, text string")
    best = {r.root: [t.text for t in r.turns] for r in chat.format_trees(table).select("root", chat.parse(F.col("formatted")).alias("turns")).collect()}
    assert best == {"a": ["hi", "good", "go on"], "z": ["alone"]}
    both = chat.format_trees(table, per_tree=2).filter("root = 'a'").orderBy("branch_rank").collect()
    assert [r.leaf for r in both] == ["d", "b"]
    assert chat.format_trees(table.limit(0)).count() == 0


def test_shards(spark, docs_of):
    texts = ODD + ["same"] * 400
    docs = docs_of(texts).unionByName(docs_of(["again", "again"], first=3))
    out = shards.external_shuffle(docs, shards=3, buckets=2)
    rows = out.collect()
    assert len(rows) == len(texts) + 2 and set(out.columns) == {*docs.columns, "shard", "bucket", "slot"}
    for s in range(3):
        slots = sorted(r.slot for r in rows if r.shard == s)
        assert slots == list(range(len(slots)))
    grown = out.select("shard", shards.shard_of(F.col("doc_id"), 4).alias("g")).collect()
    assert all(r.g in (r.shard, 3) for r in grown) and any(r.g == 3 for r in grown)
    assert sorted((r.doc_id, r.text or "") for r in rows) == sorted((r.doc_id, r.text or "") for r in docs.collect())
    order = [r.doc_id for r in sorted((r for r in rows if r.shard == 0), key=lambda r: r.slot)]
    assert order != sorted(order)
    assert shards.external_shuffle(docs.limit(0)).count() == 0


def test_buckets_of_one_key_and_written_shards(spark, docs_of, tmp_path):
    docs = docs_of([f"text {i % 700}" for i in range(1500)]).withColumn("doc_id", F.when(F.col("doc_id") % 3 > 0, F.col("doc_id")))
    out = shards.external_shuffle(docs.repartition(4), shards=2, buckets=20)
    nameless = out.filter("doc_id IS NULL").groupBy("shard", "bucket").count().collect()
    assert len({r.shard for r in nameless}) == 1 and len(nameless) == 20 and max(r["count"] for r in nameless) < 75
    shards.write_shards(out, str(tmp_path / "out"))
    for shard in range(2):
        slots = [r.slot for b in range(20) for r in spark.read.parquet(f"{tmp_path}/out/shard={shard}/bucket={b}").collect()]
        assert slots == list(range(len(slots)))
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") <= 6, plan


def test_shard_query(spark, saved_docs):
    path = saved_docs(ODD)
    rows = queries.QUERIES["op5_external_shuffle"](spark, path).collect()
    for r in rows:
        data = (ODD[r.doc_id] or "").encode()
        assert r.size == len(data) + 1 and r.text_crc32 == zlib.crc32(data) and r.grown_shard in (r.shard, 8)


def _quality(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    grams = Counter(zip(words, words[1:], words[2:], strict=False))
    covered = {j for i in range(len(words) - 2) if grams[tuple(words[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered)


def test_quality_counts(spark, saved_docs):
    rng = random.Random(4)
    texts = ODD + ["".join(rng.choice(["a", "b", "# ", " ", "\n", "c\t", "|"]) for _ in range(rng.randint(0, 200))) for _ in range(150)]
    for r in queries.QUERIES["op7_quality_rules"](spark, saved_docs(texts)).collect():
        found = _quality(texts[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == found, texts[r.doc_id]
        assert r.base_failed == (found[0] < 50 or 100 * found[4] > 50 * found[0])


def test_cascade_is_the_same_in_any_order(spark, docs_of):
    good = " ".join(f"{a}{b}" for a in "abcdefghij" for b in "klmnopqrst") + "."
    docs = docs_of([*ODD, good, good.upper(), " ".join(w + "***" for w in good.split()), "\n".join(["one two three four"] * 30)])
    rules = quality.base_rules(F.col("text")) + quality.method_rules(F.col("text"))
    kept = {r.doc_id for r in quality.cascade(docs).filter("kept").collect()}
    assert kept == {len(ODD)}
    for order in (rules, rules[::-1]):
        named = docs.withColumn("by", quality.first_rejection(order))
        assert {r.doc_id for r in named.filter("by IS NULL").collect()} == kept
    assert {(r.doc_id, r.kept) for r in quality.keep(docs).collect()} == {(len(ODD), "clash")}
    assert quality.cascade(docs.limit(0)).count() == 0


def test_rejected_texts_meet_no_later_rule(spark, docs_of):
    """Rules that fail the job if they are computed for a text that an earlier rule rejects."""
    docs = docs_of(["bad one", "bad two", "fine", "fair"])
    armed = lambda start: F.when(F.col("text").startswith(start), F.raise_error(F.lit("computed")).cast("boolean")).otherwise(F.lit(False))
    rules = [quality.Rule("first", F.col("text").startswith("bad")), quality.Rule("second", armed("bad")), quality.Rule("third", armed("bad") | (F.col("text") == "fair"))]
    found = docs.withColumn("by", quality.first_rejection(rules)).select("doc_id", "by").collect()
    assert [r.by for r in sorted(found)] == ["first", "first", None, "third"]
    from pyspark.errors import PySparkException

    with pytest.raises(PySparkException):
        docs.withColumn("by", quality.first_rejection(rules[::-1])).select("doc_id", "by").collect()


def test_rules_are_ordered_by_rejections_per_second(spark):
    sample = spark.createDataFrame([(f"text {i} " + "word " * 400,) for i in range(200)], "text string")
    slow = F.length(F.regexp_replace("text", "(?:[a-z]+ ){1,50}x", "")) < 0
    rules = [quality.Rule("slow", slow), quality.Rule("quick_and_idle", F.length("text") < 0), quality.Rule("quick", F.length("text") > 0)]
    assert [r.name for r in quality.order_rules(sample, rules)] == ["quick", "quick_and_idle", "slow"]
    assert 0 < quality.sampled(sample.union(sample), sample_rows=100).count() <= 100


@pytest.mark.parametrize(
    ("rule", "text"),
    [
        ("symbols", "wo#rd " * 60), ("capitals", "WORD Two " * 40), ("digits", "a12345 " * 60), ("equal_lines", "one two three\n" * 60), ("word_length", "a " * 60),
        ("bullets", "\n".join(f"- item number {i}" for i in range(60))), ("ellipses", "\n".join(f"read more of {i} ..." for i in range(60))), ("braces", "if (x) { y } " * 30), ("broken", "w�rd " * 60),
    ],
)
def test_each_rule_rejects(spark, docs_of, rule, text):
    rules = {r.name: r for r in quality.method_rules(F.col("text"))}
    good = " ".join(f"{a}{b}" for a in "abcdefghij" for b in "klmnopqrst") + ". And {so} on... - 12\n- item"
    assert [r.bad for r in docs_of([text, good, None]).select("doc_id", rules[rule].reject.alias("bad")).orderBy("doc_id").collect()][:2] == [True, False]
    assert len(rules) == 9


PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}


def test_license_places(spark, saved_docs):
    texts = ODD + ["The MIT License. mit license mit license MIT LICENSE", "Apache License general public license", "mitlicense", "license mit", "Licensed under CC BY-NC 4.0.", "x " * 50 + "Released under the MIT License."]
    for r in queries.QUERIES["op9_diagonal_licenses"](spark, saved_docs(texts)).collect():
        low = (texts[r.doc_id] or "").translate({c: c + 32 for c in range(65, 91)})
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
        places, labels = [], set()
        for phrase, label in PHRASES.items():
            p = phrase.split()
            for i in range(len(words) - len(p) + 1):
                if words[i : i + len(p)] == p:
                    places.append(i)
                    labels.add(label)
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == (len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels)))
        assert 0 <= r.score <= 1 and set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(","))
        if "CC BY-NC" in (texts[r.doc_id] or ""):
            assert r.labels == "cc-by-nc"


def test_license_spans_survive_edits(spark, docs_of):
    text = licenses.TEMPLATES["mit"][1]
    edited = text.replace("obtaining a copy", "obtaining one copy")
    found = licenses.spans(docs_of(["before " + edited + " after", "nothing here"])).collect()
    assert [(r.doc_id, r.label) for r in found] == [(0, "mit")] and found[0]["first"] == 1


def test_every_template_gives_its_label_alone(spark, docs_of):
    texts, labels = zip(*[(f"some words before {t} and some after", label) for label, ts in licenses.TEMPLATES.items() for t in ts], strict=True)
    found = {r.doc_id: r for r in licenses.scan(docs_of(texts), phrases={}).collect()}
    assert [(found[i].found, found[i].score) for i in range(len(texts))] == [([label], 1.0) for label in labels]
    many = " ".join(["x y z", licenses.TEMPLATES["agpl"][0], "q", licenses.TEMPLATES["gpl"][1]] * 300)
    assert sorted(licenses.scan(docs_of([many]), phrases={}).first().found) == ["agpl", "gpl"]
    assert len(licenses.TEMPLATES) >= 15


def test_rows_that_share_an_id_keep_their_labels(spark, tmp_path):
    import duckdb

    rows = [(1, "Licensed under CC BY 4.0."), (1, "nothing to see here at all"), (None, licenses.TEMPLATES["bsd"][0]), (None, None), (2, "Released under the MIT License."), (2, "")]
    spark.createDataFrame(rows, "doc_id long, text string").coalesce(2).write.parquet(str(tmp_path / "documents.parquet"))
    found = queries.QUERIES["op9_diagonal_licenses"](spark, str(tmp_path))
    expected = [(1, "cc-by", 1.0), (1, "", 0.0), (None, "bsd", 1.0), (None, "", 0.0), (2, "mit", 1.0), (2, "", 0.0)]
    assert Counter((r.doc_id, r.labels, r.score) for r in found.collect()) == Counter(expected)
    duckdb.sql(f"CREATE OR REPLACE TEMP VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    told = duckdb.sql(queries.ORACLE_SQL["op9_diagonal_licenses"]).fetchall()
    assert Counter((r[0], r[6], r[7]) for r in told) == Counter(expected)


@pytest.mark.parametrize("name", ["op1_boosted_pii", "op5_external_shuffle", "op7_quality_rules", "op9_diagonal_licenses"])
def test_empty_tables(spark, saved_docs, name):
    assert queries.QUERIES[name](spark, saved_docs([])).count() == 0
