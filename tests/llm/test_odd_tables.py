"""Empty tables, repeated rows, null and shared ids, columns of clashing names and texts of megabytes, for every operator."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from emberlog.llm import chat, decontaminate, html_text, licenses, minhash, packing, pii, quality, queries, repeats, shards

TOKENIZER = __import__("public_tokenizers").path("word_bpe_49k.json")
RNG = random.Random(41)
WORDS = [f"{a}{b}{c}" for a in "bcdfglmnprst" for b in "aeiou" for c in ("n", "rt", "sk", "ll")]
PROSE = " ".join(RNG.choice(WORDS) + ("." if i % 11 == 10 else "") for i in range(400))

#: Operators on documents, each to rows with doc_id.
OPERATORS = {
    "op1": lambda d: pii.find(d).select("doc_id", F.size("base").alias("x")),
    "op1_redact": lambda d: pii.redact(d).select("doc_id", F.length("text").alias("x")),
    "op3": lambda d: decontaminate.contaminated(d, d.sparkSession.createDataFrame([(1, "one two three four five six seven.")], "item_id long, text string")).select("doc_id", F.col("item_id").alias("x")),
    "op4": lambda d: packing.pack(d, TOKENIZER).select("doc_id", F.col("doc_tokens").alias("x")),
    "op5": lambda d: shards.external_shuffle(d, shards=3).select("doc_id", F.col("shard").alias("x")),
    "op6": lambda d: repeats.remove_repeats(d).select("doc_id", F.octet_length("kept").alias("x")),
    "op7": lambda d: quality.judged(d).select("doc_id", F.col("kept").cast("int").alias("x")),
    "op7_keep": lambda d: quality.keep(d).select("doc_id", F.lit(1).alias("x")),
    "op8": lambda d: minhash.near_duplicates(d).select("doc_id", F.col("n_shingles").alias("x")),
    "op9": lambda d: licenses.scan(d).select("doc_id", F.col("n_words").alias("x")),
    "op10": lambda d: html_text.extract(d, html="text", into="out").select("doc_id", F.length("out").alias("x")),
}
#: Operators that give some rows only.
SOME = {"op3", "op7_keep"}


def _rows(spark, rows, **clashing):
    table = spark.createDataFrame(rows, "doc_id long, text string")
    return table.withColumns({name: F.lit("mine") for name in clashing.get("names", ())})


@pytest.mark.parametrize("name", OPERATORS)
def test_empty_tables(spark, name):
    assert OPERATORS[name](_rows(spark, [])).collect() == []


@pytest.mark.parametrize("name", OPERATORS)
def test_null_and_shared_ids_and_repeated_rows(spark, name):
    rows = [(None, PROSE), (None, None), (None, ""), (1, PROSE[:900]), (1, "one two three four five six seven."), (1, PROSE[:900]), (2, "x")]
    found = OPERATORS[name](_rows(spark, rows)).collect()
    ids = Counter(r.doc_id for r in found)
    if name in SOME:
        assert set(ids) <= {None, 1, 2} and ids
    else:
        least = Counter(i for i, _ in rows)
        assert set(ids) == set(least) and all(ids[i] >= n for i, n in least.items())
        assert name == "op4" or ids == least


@pytest.mark.parametrize("name", OPERATORS)
def test_clashing_columns(spark, name):
    names = ["base", "added", "kept", "removed", "n", "n_words", "word_chars", "n_lines", "score", "found", "label", "shard", "bucket", "slot", "start", "length", "ids", "t", "u", "component_id", "n_shingles", "item_id", "key", "id", "g", "p", "anchor", "whole", "n_base"]
    rows = [(i, t) for i, t in enumerate([PROSE, PROSE + " tail", "one two three four five six seven.", None])]
    plain, clash = (sorted(map(repr, OPERATORS[name](_rows(spark, rows, names=n)).collect())) for n in ((), names))
    assert plain == clash and plain


@pytest.mark.parametrize("name", OPERATORS)
def test_texts_of_megabytes(spark, name):
    """Many matches of all kinds in one text of 2 MB, beside small ones."""
    unit = PROSE + " mail a@b.co 10.0.0.1 token: 0123456789abcdef0123456789abcdef Licensed under CC BY 4.0. <p>MIT License</p> one two three four five six seven.\n"
    long = "".join(unit.replace("a@b", f"a{i}@b") for i in range((2 << 20) // len(unit)))
    found = {r.doc_id: r.x for r in OPERATORS[name](_rows(spark, [(1, long), (2, "x"), (3, PROSE)])).collect()}
    assert 1 in found or name == "op7_keep"


def test_conversations(spark):
    schema = "conv_id long, turn long, role string, text string"
    assert chat.format_trees(chat.linear_threads(spark.createDataFrame([], schema))).count() == 0
    rows = [(1, 0, "user", "q"), (1, 0, "user", "q"), (1, None, None, None), (None, 0, "assistant", "x" * 2_000_000)]
    table = spark.createDataFrame(rows, schema).withColumns({c: F.lit("mine") for c in ("root", "leaf", "id", "parent", "score", "formatted", "mask")})
    out = chat.format_trees(chat.linear_threads(table)).select("root", F.size(chat.parse(F.col("formatted"))).alias("n"), F.length(chat.under_mask(F.col("formatted"), F.col("mask"))).alias("m")).collect()
    assert {(r.root, r.n, r.m) for r in out} == {(":1", 1, 2_000_000), ("1:1", 3, 0)}


@pytest.mark.parametrize("rows", [[], [(None, None), (None, None)]])
def test_pipeline(spark, tmp_path, rows):
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert queries.QUERIES["pipeline"](spark, str(tmp_path)).count() == 0


def test_pages(spark, tmp_path):
    spark.createDataFrame([], "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    assert queries.QUERIES["op10_tree_scoring"](spark, str(tmp_path)).count() == 0
