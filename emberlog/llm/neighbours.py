"""Quality scores by votes of labelled neighbours in a latent-semantic space.

A text's terms are the shapes of its words (letters by case, digits and signs, runs as one), pairs of neighbouring shapes, and
marks of words that repeat the one before or stand in the text already. Terms are hashed into TERMS columns, weighted by the
root of their share and by their entropy over the labelled rows, and projected on the first singular vectors of the labelled
rows. Each document meets every labelled vector in blocks of exact cosine products; its NEAREST neighbours vote for their label,
weighted by a power of the similarity.

fit() takes MAX_LABELLED labelled rows at most, those of least hash, so the model, which goes to all tasks, has a size of its
own: MAX_LABELLED vectors of DIMENSIONS numbers and one projection. Everything else covers all rows and whole texts, in one pass.

Null or empty text has the term of empty texts alone and is voted on like all others. Repeated rows and rows that share an id are
scored each for itself; equal texts get equal scores but for the rounding of floats. Among neighbours of equal similarity, those that come first in the model
vote. Labels that are null are left out; a row with both labels has their mean. An empty table gives an empty table; without
labelled rows every score is 0.5. Columns of other names pass through; those named score or predicted are replaced.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StructField, StructType

from emberlog.llm.memory import small_batches, tidy

#: Rows that a model is fitted on at most, hashed terms, dimensions of the latent space, voters and the power of their weight.
MAX_LABELLED, TERMS, DIMENSIONS, NEAREST, POWER = 4096, 2048, 48, 15, 8
THRESHOLD = 0.7
#: Rows of text that are counted at once, and bytes after which a slice ends.
BLOCK_ROWS, BLOCK_BYTES = 256, 4 << 20
_EMPTY, _SAME, _SEEN, _FRESH, _MARKS = 0, 1, 2, 3, 4
#: Places in an order of the terms: marks, then shapes, then pairs of shapes.
_SHAPES = (TERMS - _MARKS) // 2


@dataclass(frozen=True)
class Model:
    """weights: of each term; axes: terms x dimensions; vectors: unit rows of the labelled texts; labels: theirs."""

    weights: np.ndarray
    axes: np.ndarray
    vectors: np.ndarray
    labels: np.ndarray


def _shapes(words: pa.Array) -> np.ndarray:
    """A number under _SHAPES for each of the words: letters become A or a, digits 0, and runs of one character that character."""
    shape = words
    for pattern, sign in ((r"\p{Lu}+", "A"), (r"[\p{Ll}\p{Lt}\p{Lm}\p{Lo}]+", "a"), (r"\p{N}+", "0")):
        shape = pc.replace_substring_regex(shape, pattern, sign)
    coded = shape.dictionary_encode()
    numbers = []
    for s in coded.dictionary.to_pylist():
        runs = "".join(c for i, c in enumerate(s) if i == 0 or s[i - 1] != c)
        numbers.append(zlib.crc32(runs.encode("utf-8", "replace")) % _SHAPES)
    return np.array(numbers, np.int64)[coded.indices.to_numpy()] if numbers else np.empty(0, np.int64)


def term_counts(texts: pa.Array) -> np.ndarray:
    """len(texts) x TERMS, how often each term stands in each text."""
    n = len(texts)
    lists = pc.split_pattern_regex(pc.fill_null(texts.cast(pa.large_string()), ""), r"[ \t\n\v\f\r]+")
    lengths = pc.list_value_length(lists).to_numpy().astype(np.int64)
    doc = np.repeat(np.arange(n), lengths)
    coded = pc.list_flatten(lists).dictionary_encode()
    word = coded.indices.to_numpy().astype(np.int64)
    blank = pc.equal(pc.utf8_length(coded.dictionary), 0).to_numpy(zero_copy_only=False)
    real = ~blank[word] if len(word) else np.empty(0, bool)
    doc, word = doc[real], word[real]
    counts = np.zeros(n * TERMS, np.float32)
    if len(word):
        shape = _shapes(coded.dictionary)[word]
        together = doc[1:] == doc[:-1]
        same = together & (word[1:] == word[:-1])
        place = np.argsort(doc * (len(blank) + 1) + word, kind="stable")
        again = np.zeros(len(word), bool)
        again[place[1:]] = (word[place[1:]] == word[place[:-1]]) & (doc[place[1:]] == doc[place[:-1]])
        pair = _MARKS + _SHAPES + (shape[:-1] * 1_000_003 + shape[1:] * 7919) % _SHAPES
        mark = np.where(again, _SEEN, _FRESH)
        mark[1:][same] = _SAME
        cells = np.concatenate([doc * TERMS + mark, doc * TERMS + _MARKS + shape, (doc[1:] * TERMS + pair)[together]])
        counts = np.bincount(cells, minlength=n * TERMS).astype(np.float32)
    counts = counts.reshape(n, TERMS)
    counts[counts.sum(axis=1) == 0, _EMPTY] = 1
    return counts


def _parts(counts: np.ndarray) -> np.ndarray:
    """Roots of the shares of terms among marks, shapes and pairs; each part has the length one, or zero."""
    out = np.empty_like(counts)
    for a, z in ((0, _MARKS), (_MARKS, _MARKS + _SHAPES), (_MARKS + _SHAPES, TERMS)):
        total = counts[:, a:z].sum(axis=1, keepdims=True)
        out[:, a:z] = np.sqrt(counts[:, a:z] / np.maximum(total, 1))
    return out


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


def fitted(counts: np.ndarray, labels: np.ndarray, seed: int = 7) -> Model:
    """The model of labelled rows: entropy weights, and singular vectors by subspace iteration."""
    x = _parts(counts)
    n = max(len(x), 2)
    share = x / np.maximum(x.sum(axis=0, keepdims=True), 1e-12)
    entropy = -(share * np.log(np.maximum(share, 1e-12))).sum(axis=0) / np.log(n)
    # Terms that stand everywhere alike still count for half: how much of a text they make up tells as well.
    weights = (1 - 0.5 * entropy).astype(np.float32)
    x = x * weights
    start = np.random.default_rng(seed).standard_normal((TERMS, DIMENSIONS + 16)).astype(np.float32)
    basis = np.linalg.qr(x.T @ (x @ start))[0]
    for _ in range(6):
        basis = np.linalg.qr(x.T @ (x @ basis))[0]
    _, _, right = np.linalg.svd(x @ basis, full_matrices=False)
    axes = np.ascontiguousarray((basis @ right.T)[:, :DIMENSIONS], np.float32)
    return Model(weights, axes, np.ascontiguousarray(_unit(x @ axes), np.float32), labels.astype(np.float32))


def votes(counts: np.ndarray, model: Model, nearest: int = NEAREST) -> np.ndarray:
    """A score for each row of counts."""
    if not len(model.labels):
        return np.full(len(counts), 0.5)
    likeness = _unit((_parts(counts) * model.weights) @ model.axes) @ model.vectors.T
    k = min(nearest, len(model.labels))
    # Rounded, so that equal texts tie whatever block they stand in; ties go to the first of the model.
    likeness = np.round(likeness.astype(np.float64), 5)
    order = np.arange(likeness.shape[1])
    ranked = likeness - order * 1e-10
    top = np.argpartition(-ranked, k - 1, axis=1)[:, :k]
    top = np.sort(top, axis=1)
    weight = np.maximum(np.take_along_axis(likeness, top, axis=1), 1e-6) ** POWER
    return np.clip((weight * model.labels[top]).sum(axis=1) / weight.sum(axis=1), 0, 1)


def _slices(texts: pa.Array) -> Iterator[tuple[int, int]]:
    """Runs of rows of BLOCK_ROWS and BLOCK_BYTES at most, one row at least."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    a = 0
    while a < len(texts):
        z = int(np.searchsorted(ends, (ends[a - 1] if a else 0) + BLOCK_BYTES, side="right"))
        z = min(max(z, a + 1), a + BLOCK_ROWS)
        yield a, z
        a = z


def _counting(text: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index(text))
            for a, z in _slices(texts):
                rows = term_counts(texts.slice(a, z - a))
                out = pa.array([r.tobytes() for r in rows], pa.binary())
                yield pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index("__label")).slice(a, z - a), out], ["label", "counts"])

    return tidy(run)


def fit(docs: DataFrame, labelled: DataFrame, *, key: str = "doc_id", text: str = "text", label: str = "quality", most: int = MAX_LABELLED) -> Model:
    """labelled: key and label (0 to 1); only the `most` keys of least hash are learned from."""
    small_batches(docs.sparkSession)
    known = labelled.filter(F.col(key).isNotNull() & F.col(label).isNotNull()).groupBy(F.col(key).alias("__key")).agg(F.avg(F.col(label).cast("double")).alias("__label"))
    known = known.orderBy(F.xxhash64("__key"), "__key").limit(most)
    texts = docs.select(F.col(key).alias("__key"), F.col(text).alias("__text")).join(F.broadcast(known), "__key")
    # Rows that share an id are one labelled text, the least, so that the bound holds.
    texts = texts.groupBy("__key", "__label").agg(F.min(F.coalesce("__text", F.lit(""))).alias("__text"))
    rows = texts.mapInArrow(_counting("__text"), "label double, counts binary").collect()
    rows.sort(key=lambda r: (bytes(r.counts), r.label))
    counts = np.stack([np.frombuffer(r.counts, np.float32) for r in rows]) if rows else np.zeros((0, TERMS), np.float32)
    if not rows:
        return Model(np.ones(TERMS, np.float32), np.zeros((TERMS, DIMENSIONS), np.float32), np.zeros((0, DIMENSIONS), np.float32), np.zeros(0, np.float32))
    return fitted(counts, np.array([r.label for r in rows]))


def score(docs: DataFrame, model: Model, *, text: str = "text", threshold: float = THRESHOLD, keep: Sequence[str] | None = None) -> DataFrame:
    """The columns in keep (all, if none are named) with score double and predicted int; one pass, no shuffle."""
    spark = docs.sparkSession
    small_batches(spark)
    held = spark.sparkContext.broadcast(model)
    passed = [c for c in (docs.columns if keep is None else keep) if c not in ("score", "predicted")]
    rows = docs.select(*passed, F.col(text).alias("__text"))
    fields = [*rows.schema.fields[:-1], StructField("score", DoubleType()), StructField("predicted", IntegerType())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(len(passed))
            for a, z in _slices(texts):
                found = votes(term_counts(texts.slice(a, z - a)), held.value)
                columns = [c.slice(a, z - a) for c in batch.columns[:-1]]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(found, pa.float64()), pa.array((found >= threshold).astype(np.int32))], [*passed, "score", "predicted"])

    return rows.mapInArrow(tidy(run), StructType(fields))


def remainder(key: Column, parts: int) -> Column:
    """crc32 of the key as text, modulo parts; a null key counts as empty text."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % parts
