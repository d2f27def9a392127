"""Statistics of data sets: lengths, vocabularies, their heads and how far these overlap."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberlog.operators import vocabulary
from emberlog.operators.joins import joined
from emberlog.operators.selection import with_quantiles
from emberlog.sources.written import saved


def dataset_statistics(rows: DataFrame, dataset: str, text: str, percentile: float = 0.9, min_frequency: int | None = None, ignored: Sequence[str] = (), split_case: bool = True) -> tuple[DataFrame, DataFrame]:
    """For each data set (a column's value, null included) documents, words, mean, stdev and median of words in a document, vocabulary
    (different tokens) and head (the most frequent tokens that make up the percentile of all); and a, b and overlap (shared tokens of
    two heads over those of either) for data sets whose heads share any."""
    counted = rows.select(F.col(dataset).alias("dataset"), vocabulary.tokens(F.col(text), split_case).alias("words")).withColumn("n", F.size("words"))
    lengths = saved(counted.select("dataset", "n"))
    sizes = lengths.groupBy("dataset").agg(F.count("*").alias("documents"), F.sum("n").alias("words"), F.avg("n").alias("mean"), F.stddev_pop("n").alias("stdev"))
    sizes = with_quantiles(sizes, lengths, "n", {"median": 0.5}, ["dataset"])
    vocab = saved(counted.select("dataset", F.explode("words").alias("token")).groupBy("dataset", "token").agg(F.count("*").alias("n")))
    heads = saved(vocabulary.head(vocab, percentile=percentile, min_frequency=min_frequency, ignored=ignored, by=["dataset"]))
    count = lambda df, name: df.groupBy("dataset").agg(F.count("*").alias(name))
    out = joined(joined(sizes, count(vocab, "vocabulary"), "dataset", "left"), count(heads, "head"), "dataset", "left")
    return out.fillna(0, ["vocabulary", "head"]), vocabulary.jaccard(heads.select("dataset", "token"), "dataset")
