"""Quality of summaries: ROUGE, BLEU, METEOR without synonyms, and derived measures."""

from __future__ import annotations

import math
from collections import Counter, deque
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberlog.functions.text import bound
from emberlog.operators.vocabulary import tokens


def ngrams(words: Column, n: int) -> Column:
    """array<string>: n words each, joined by a space."""

    def of(w: Column) -> Column:
        some = F.transform(F.sequence(F.lit(1), F.size(w) - n + 1), lambda i: F.array_join(F.slice(w, i, F.lit(n)), " "))
        return F.when(F.size(w) >= n, some).otherwise(F.array().cast("array<string>"))

    return bound(words, of)


#: The endings that stem() takes off, the longest that leaves three letters.
ENDINGS = ("ations", "ation", "ingly", "edly", "ings", "ing", "ies", "ed", "es", "ly", "s")


def stemmed(words: Column) -> Column:
    """stem() of each word, as a column."""
    return F.transform(words, lambda w: F.regexp_replace(w, f"^(.{{3,}}?)(?:{'|'.join(ENDINGS)})$", "$1"))


def shared_count(a: Column, b: Column) -> Column:
    """How many elements two arrays of strings share, each as often as both have it; both are sorted together and swept once."""
    told = lambda xs, mine: F.transform(xs, lambda x: F.struct(x.alias("x"), F.lit(mine).alias("m")))
    state = "struct<x: string, a: bigint, b: bigint, n: bigint>"

    def step(s: Column, e: Column) -> Column:
        one, other = F.when(e["m"], 1).otherwise(0), F.when(e["m"], 0).otherwise(1)
        more = F.struct(s["x"].alias("x"), (s["a"] + one).alias("a"), (s["b"] + other).alias("b"), s["n"].alias("n")).cast(state)
        fresh = F.struct(e["x"].alias("x"), one.alias("a"), other.alias("b"), (s["n"] + F.least(s["a"], s["b"])).alias("n")).cast(state)
        return F.when(s["x"] == e["x"], more).otherwise(fresh)

    start = F.struct(F.lit("").alias("x"), F.lit(0).alias("a"), F.lit(0).alias("b"), F.lit(0).alias("n")).cast(state)
    return F.aggregate(F.sort_array(F.concat(told(a, True), told(b, False))), start, step, lambda s: s["n"] + F.least(s["a"], s["b"]))


def _grams(text: str, n: int, stems: bool) -> Column:
    words = tokens(F.col(text), split_case=False)
    return ngrams(stemmed(words) if stems else words, n)


def shared_ngrams(pairs: DataFrame, key: str, prediction: str, reference: str, n: int = 1, stems: bool = False) -> DataFrame:
    """key, shared (n-grams that both have, by counts), predicted and referred (n-grams of each); each row by itself, without a
    shuffle."""
    base = pairs.select(key, _grams(prediction, n, stems).alias("__p"), _grams(reference, n, stems).alias("__r"))
    return base.select(key, shared_count(F.col("__p"), F.col("__r")).alias("shared"), F.size("__p").alias("predicted"), F.size("__r").alias("referred"))


def rouge_n(pairs: DataFrame, key: str, prediction: str, reference: str, n: int = 1, stems: bool = False) -> DataFrame:
    """key, precision, recall, f1 of shared n-grams (by counts), of words or of their stems."""
    share = lambda size: F.when(F.col(size) > 0, F.col("shared") / F.col(size)).otherwise(F.lit(0.0))
    f1 = F.when(F.col("shared") > 0, 2 * F.col("shared") / (F.col("predicted") + F.col("referred"))).otherwise(F.lit(0.0))
    return shared_ngrams(pairs, key, prediction, reference, n, stems).select(key, share("predicted").alias("precision"), share("referred").alias("recall"), f1.alias("f1"))


def corpus_bleu(pairs: DataFrame, key: str, prediction: str, reference: str, most: int = 4) -> DataFrame:
    """One row: bleu over all pairs together (counts of all are added up first), precision_1 to precision_most and brevity; one pass
    for runs of all lengths."""
    orders = range(1, most + 1)
    base = pairs.select(*(_grams(c, n, False).alias(f"__{side}{n}") for n in orders for side, c in (("p", prediction), ("r", reference))))
    sums = base.agg(*(F.sum(shared_count(F.col(f"__p{n}"), F.col(f"__r{n}"))).alias(f"s{n}") for n in orders), *(F.sum(F.size(f"__p{n}")).alias(f"p{n}") for n in orders), F.sum(F.size("__r1")).alias("r1"))
    parts = [F.when(F.col(f"p{n}") > 0, F.col(f"s{n}") / F.col(f"p{n}")).otherwise(F.lit(0.0)).alias(f"precision_{n}") for n in orders]
    brevity = F.when(F.col("p1") >= F.col("r1"), F.lit(1.0)).when(F.col("p1") > 0, F.exp(1 - F.col("r1") / F.col("p1"))).otherwise(F.lit(0.0))
    out = sums.select(*parts, brevity.alias("brevity"))
    logs = sum((F.log(F.nullif(F.col(f"precision_{n}"), F.lit(0.0))) for n in orders), F.lit(0.0))
    return out.withColumn("bleu", F.col("brevity") * F.coalesce(F.exp(logs / most), F.lit(0.0)))


def _columns(b: Sequence) -> dict:
    """For each token of b, a number with a bit set at each of its places."""
    out: dict = {}
    for j, y in enumerate(b):
        out[y] = out.get(y, 0) | 1 << j
    return out


def _next_row(row: int, match: int, full: int) -> int:
    """Bit vectors of longest common subsequences: bit j of a row is 0 where b's first j + 1 tokens have one more in common with a's
    tokens so far than its first j; match has the places of a's next token."""
    both = row & match
    return ((row + both) | (row - both)) & full


def lcs_length(a: Sequence, b: Sequence) -> int:
    """Length of the longest common subsequence; a word of bits at a time."""
    columns, full = _columns(b), (1 << len(b)) - 1
    row = full
    for x in a:
        row = _next_row(row, columns.get(x, 0), full)
    return len(b) - row.bit_count()


def _lcs_places(a: Sequence, b: Sequence) -> set[int]:
    """Places of a that one longest common subsequence uses: the one that going back from both ends finds, where a token of a is
    dropped first if either could be.

    Rows of bits are kept at every so many tokens of a only, and those between are made again on the way back.
    """
    columns, full = _columns(b), (1 << len(b)) - 1
    stride = math.isqrt(len(a)) + 1
    kept, row = [full], full
    for i, x in enumerate(a, 1):
        row = _next_row(row, columns.get(x, 0), full)
        if i % stride == 0:
            kept.append(row)
    found: set[int] = set()
    i, j, rows, first = len(a), len(b), [], len(a) + 1
    common = lambda i, j: j - (rows[i - first] & ((1 << j) - 1)).bit_count()
    while i and j:
        if i - 1 < first:
            first = (i - 1) // stride * stride
            rows = [kept[first // stride]]
            for x in a[first : first + stride]:
                rows.append(_next_row(rows[-1], columns.get(x, 0), full))
        if a[i - 1] == b[j - 1]:
            found.add(i - 1)
            i, j = i - 1, j - 1
        elif common(i - 1, j) >= common(i, j - 1):
            i -= 1
        else:
            j -= 1
    return found


def summary_lcs(prediction: Sequence[Sequence], reference: Sequence[Sequence]) -> int:
    """Tokens of the reference in the union of common subsequences with all sentences of the prediction, each token as often
    as both sides have it."""
    left, right = Counter(t for s in prediction for t in s), Counter(t for s in reference for t in s)
    hits = 0
    for sentence in reference:
        for i in sorted(set().union(*(_lcs_places(sentence, p) for p in prediction)) if prediction else ()):
            t = sentence[i]
            if left[t] > 0 and right[t] > 0:
                hits += 1
                left[t] -= 1
                right[t] -= 1
    return hits


def bleu(prediction: Sequence, reference: Sequence, most: int = 4) -> float:
    """Sentence BLEU with one added to the counts of all orders above the first; 0 without a shared word."""
    if not prediction or not reference:
        return 0.0
    logs = 0.0
    for n in range(1, most + 1):
        a, b = (Counter(tuple(x[i : i + n]) for i in range(len(x) - n + 1)) for x in (prediction, reference))
        shared, total = sum((a & b).values()), max(sum(a.values()), 1)
        if n == 1 and not shared:
            return 0.0
        logs += math.log((shared + (n > 1)) / (total + (n > 1)))
    short = min(1.0, math.exp(1 - len(reference) / len(prediction)))
    return short * math.exp(logs / most)


def stem(word: str) -> str:
    """A word without its common English endings."""
    for end in ENDINGS:
        if word.endswith(end) and len(word) - len(end) >= 3:
            return word[: -len(end)]
    return word


def meteor(prediction: Sequence[str], reference: Sequence[str]) -> float:
    """Exact matches, then those of stems; weighted harmonic mean, less a penalty for scattered matches."""
    taken: dict[int, int] = {}
    used: set[int] = set()
    for form in (str, stem):
        free: dict[str, deque[int]] = {}
        for j, r in enumerate(reference):
            if j not in used:
                free.setdefault(form(r), deque()).append(j)
        for i, w in enumerate(prediction):
            if i not in taken and free.get(form(w)):
                taken[i] = free[form(w)].popleft()
                used.add(taken[i])
    if not taken:
        return 0.0
    precision, recall = len(taken) / len(prediction), len(taken) / len(reference)
    mean = 10 * precision * recall / (recall + 9 * precision)
    places = sorted(taken.items())
    chunks = 1 + sum(not (a[0] + 1 == b[0] and a[1] + 1 == b[1]) for a, b in zip(places, places[1:], strict=False))
    return mean * (1 - 0.5 * (chunks / len(taken)) ** 3)


def sequence_metrics(pairs: DataFrame, key: str, prediction: str, reference: str, stems: bool = False) -> DataFrame:
    """key, rouge_l and rouge_lsum (by lines) of the longest common subsequence, each as F1 and with _precision and _recall, bleu
    and meteor; stems: ROUGE compares words without their endings."""
    names = [f"{r}{x}" for r in ("rouge_l", "rouge_lsum") for x in ("", "_precision", "_recall")] + ["bleu", "meteor"]

    def split(text: str | None) -> list[str]:
        return (text or "").lower().split()

    def run(batches):
        form = stem if stems else str
        for batch in batches:
            rows = []
            for p, r in zip(batch[prediction], batch[reference], strict=True):
                a, b = split(p), split(r)
                lines = [[[form(w) for w in split(x)] for x in (t or "").split("\n")] for t in (p, r)]
                told = lambda s, a=a, b=b: (2 * s / (len(a) + len(b)), s / len(a), s / len(b)) if s else (0.0, 0.0, 0.0)
                rows.append((*told(lcs_length([form(w) for w in a], [form(w) for w in b])), *told(summary_lcs(*lines)), bleu(a, b), meteor(a, b)))
            yield pd.DataFrame({key: batch[key], **{n: [float(x[i]) for x in rows] for i, n in enumerate(names)}})

    kind = pairs.schema[key].dataType.simpleString()
    return pairs.select(key, prediction, reference).mapInPandas(run, f"{key} {kind}, " + ", ".join(f"{n} double" for n in names))


def perplexity(loss: Column) -> Column:
    """exp(loss); infinite where that is too large."""
    return F.when(loss > 709.78, F.lit(float("inf"))).otherwise(F.exp(loss))


def throughput(n: Column, seconds: Column) -> Column:
    return F.when(seconds > 0, n / seconds)
