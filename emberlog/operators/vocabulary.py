"""Vocabularies: token counts, heads, overlaps, and statistics of lengths and of collections."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberlog.functions.text import case_words
from emberlog.operators.joins import joined
from emberlog.operators.places import placed
from emberlog.operators.selection import same_group, with_quantiles
from emberlog.sources.written import saved

#: Common English function words, the default for the parameter of that name.
STOP_WORDS = (
    "a about above after again all also am an and any are as at be because been before being below between both but by can could did do does doing don down during each few for from further had has have having he her here hers "
    "him his how i if in into is it its just me more most my no nor not now of off on once only or other our out over own same she should so some such than that the their them then there these they this those through to too "
    "under until up very was we were what when where which while who whom why will with would you your"
).split()


def tokens(text: Column, split_case: bool = True) -> Column:
    """Words of letters and digits; split_case takes mixed case apart; all in lower case."""
    words = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0))
    if split_case:
        words = F.flatten(F.transform(words, case_words))
    return F.transform(words, F.lower)


def vocabulary(df: DataFrame, text: str, by: Sequence[str] = (), split_case: bool = True) -> DataFrame:
    """token and n, of all rows or of each group."""
    return df.select(*by, F.explode(tokens(F.col(text), split_case)).alias("token")).groupBy(*by, "token").agg(F.count(F.lit(1)).alias("n"))


def head(vocab: DataFrame, n: int | None = None, min_frequency: int | None = None, percentile: float | None = None, ignored: Sequence[str] | DataFrame = (), by: Sequence[str] = ()) -> DataFrame:
    """The most frequent tokens with their rank (from 1, ties by token): without ignored ones, at most n, at least min_frequency
    times, and while their running sum is at most percentile of all counts (ignored ones included).

    Ranks and running sums come from tasks' ranges and their totals, so a vocabulary without groups needs no single task.
    """
    # Counts are few beside the texts that they come from; ranges are dealt by a sample, and totals read them once more.
    vocab = saved(vocab)
    out = vocab
    if isinstance(ignored, DataFrame):
        out = joined(out, ignored.select("token"), "token", "left_anti")
    elif ignored:
        out = out.filter(~F.col("token").isin(*ignored))
    if min_frequency:
        # Counts fall along the ranks, so this cuts the end off and changes no rank.
        out = out.filter(F.col("n") >= min_frequency)
    out = placed(out, by, ["n", "token"], into="rank", sums={"__run": "n"}, descending=["n"]).withColumn("rank", F.col("rank") + 1)
    if n:
        out = out.filter(F.col("rank") <= n)
    if percentile is not None:
        total = vocab.groupBy(*[F.col(b).alias(f"__{b}") for b in by]).agg(F.sum("n").alias("__total"))
        out = out.join(total if by else F.broadcast(total), same_group(by)).filter(F.col("__run") <= F.col("__total") * percentile)
    return out.select(*vocab.columns, "rank")


def jaccard(heads: DataFrame, by: str) -> DataFrame:
    """a, b (a < b) and overlap: shared tokens over tokens of either, for all pairs of groups that share one, else none."""
    sizes = heads.groupBy(by).agg(F.countDistinct("token").alias("size"))
    left, right = heads.select(F.col(by).alias("a"), "token").distinct(), heads.select(F.col(by).alias("b"), "token").distinct()
    both = left.join(right, "token").filter("a < b").groupBy("a", "b").agg(F.count(F.lit(1)).alias("shared"))
    out = both.join(sizes.select(F.col(by).alias("a"), F.col("size").alias("na")), "a").join(sizes.select(F.col(by).alias("b"), F.col("size").alias("nb")), "b")
    return out.select("a", "b", (F.col("shared") / (F.col("na") + F.col("nb") - F.col("shared"))).alias("overlap"))


def length_stats(df: DataFrame, value: str, by: Sequence[str] = ()) -> DataFrame:
    """n, mean, stdev (population) and median (exact, by selection)."""
    v = F.col(value)
    first = df.groupBy(*by).agg(F.count(v).alias("n"), F.avg(v).alias("mean"), F.stddev_pop(v).alias("stdev"))
    return with_quantiles(first, df, value, {"median": 0.5}, by)


def box_stats(df: DataFrame, value: str, by: Sequence[str] = ()) -> DataFrame:
    """mean, quartiles (exact, by selection), whiskers (extreme values within 1.5 interquartile ranges), outliers below and above, min,
    max, stdev."""
    v = F.col(value)
    first = df.groupBy(*by).agg(F.avg(v).alias("mean"), F.min(v).alias("min"), F.max(v).alias("max"), F.stddev_pop(v).alias("stdev"))
    first = saved(with_quantiles(first, df, value, {"q1": 0.25, "median": 0.5, "q3": 0.75}, by))
    reach = 1.5 * (F.col("q3") - F.col("q1"))
    bounds = first.select(*[F.col(b).alias(f"__{b}") for b in by], (F.col("q1") - reach).alias("__lo"), (F.col("q3") + reach).alias("__hi"))
    rows = df.join(bounds if by else F.broadcast(bounds), same_group(by))
    inside = v.between(F.col("__lo"), F.col("__hi"))
    second = rows.groupBy(*[F.col(b).alias(f"__{b}") for b in by]).agg(
        F.min(F.when(inside, v)).alias("whisker_low"), F.max(F.when(inside, v)).alias("whisker_high"), F.count_if(v < F.col("__lo")).alias("outliers_low"), F.count_if(v > F.col("__hi")).alias("outliers_high")
    )
    return first.join(second if by else F.broadcast(second), same_group(by), "left").drop(*[f"__{b}" for b in by])
