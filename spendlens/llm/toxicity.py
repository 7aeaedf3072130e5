"""Toxicity by non-negative positive-unlabelled learning of a numpy linear classifier.

Confirmed toxic texts are the positives; all other training texts are unlabelled, a mixture with ``prior`` positives
(the share of toxic rows among those labelled). With the logistic loss l, the classifier minimises

    prior * E_P[l(+g)] + max(0, E_U[l(-g)] - prior * E_P[l(-g)])

that is, the risk on the unlabelled texts as negatives less what the positives among them add to it, held at zero.

Features are the words of a text and their beginnings of 4 to 8 bytes, hashed to ``1 << sketch.BITS`` cells, over the whole
text. A cell's value is how often it occurs in ``PER_WORDS`` words (a text counts as ``LEAST_WORDS`` at least), up to
``MOST_VALUE``, so a score does not grow with length: what matters is how dense such words are. All cells are kept that
occur ``LEAST_RATIO`` times as often in positive texts as in unlabelled ones, in ``LEAST_TEXTS`` of them, and by ``EXCESS``
standard deviations of a Poisson count more often than chance.
Training uses at most ``MOST_POSITIVE`` and ``MOST_UNLABELLED`` texts, those of the smallest hashes of their ids;
scoring covers every text. The driver gets counts per cell and the kept features of the training texts.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import sketch
from .bpe import sliced
from .wordhash import ALNUM, LOWER, mix, spans
from .work import stored

MOST_POSITIVE = 4_000
MOST_UNLABELLED = 12_000
LEAST_RATIO, LEAST_TEXTS, EXCESS = 3.0, 3, 5.0
PER_WORDS, LEAST_WORDS, MOST_VALUE = 250, 100, 4.0
BEGINNINGS = range(4, 9)
#: When cells are chosen, a text counts as so many words at most, and a cell so often in it, so that no text outweighs others.
MOST_WORDS, MOST_COUNTED = 1000, 4
#: Words taken at a time.
PIECE = 1 << 16


def text_cells(raw) -> Iterator[np.ndarray]:
    """The feature cells of a whole text with repetitions: for every word its own, and those of its shorter beginnings."""
    if not raw:
        return
    hashes, first, last = spans(raw, ALNUM)
    data = np.concatenate([LOWER[np.frombuffer(raw, dtype=np.uint8)], np.zeros(max(BEGINNINGS), dtype=np.uint8)])
    for low in range(0, len(hashes), PIECE):
        at, size = first[low:low + PIECE], (last - first)[low:low + PIECE]
        yield sketch.cells(hashes[low:low + PIECE])
        begin = np.zeros(len(at), dtype=np.uint64)
        for n in range(1, max(BEGINNINGS) + 1):
            begin = (begin << np.uint64(8)) | data[at + n - 1]
            if n in BEGINNINGS:
                yield sketch.cells(mix(begin[size > n] ^ mix(np.array([n], dtype=np.uint64))))


def cell_counts(raw) -> tuple[np.ndarray, np.ndarray, int]:
    """The distinct cells of a text, how often each occurs, and the number of words."""
    found = list(text_cells(raw))
    words = sum(map(len, found[::1 + len(BEGINNINGS)]))
    cells, counts = np.unique(np.concatenate(found) if found else np.zeros(0, dtype=np.int64), return_counts=True)
    return cells, counts, words


def values(counts: np.ndarray, words: int) -> np.ndarray:
    return np.minimum(counts * (PER_WORDS / max(words, LEAST_WORDS)), MOST_VALUE)


@dataclass
class Classifier:
    """score = sigmoid(bias + sum of weight * value over the cells that a text has)."""

    bias: float
    weights: np.ndarray

    def score(self, raw) -> float:
        cells, counts, words = cell_counts(raw)
        g = self.bias + float(self.weights[cells].astype(float) @ values(counts, words))
        return float(1 / (1 + np.exp(-np.clip(g, -30, 30))))


class SparseRows:
    """Rows of which only the entries (row, column, value) are held; has the products that ``fit_nnpu`` needs."""

    __array_ufunc__ = None

    def __init__(self, shape: tuple[int, int], row: np.ndarray, column: np.ndarray, value: np.ndarray):
        self.shape, self.row, self.column, self.value = shape, row, column, value

    def __matmul__(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, weights=self.value * w[self.column], minlength=self.shape[0])

    def __rmatmul__(self, d: np.ndarray) -> np.ndarray:
        return np.bincount(self.column, weights=self.value * d[self.row], minlength=self.shape[1])


def fit_nnpu(positive, unlabelled, prior: float, rounds: int = 400, rate: float = 0.05,
             decay: float = 1e-3) -> tuple[float, np.ndarray]:
    """(bias, weights) of a linear g on features (arrays or ``SparseRows``) that minimises the non-negative risk; Adam over
    all rows.

    While the corrected negative risk is below zero, its gradient is followed upwards instead, so that the classifier
    does not fit the positives among the unlabelled rows as negatives.
    """
    w, b = np.zeros(positive.shape[1]), float(np.log(prior / (1 - prior)))
    m, v = np.zeros(len(w) + 1), np.zeros(len(w) + 1)
    sigmoid = lambda z: 1 / (1 + np.exp(-np.clip(z, -30, 30)))
    loss = lambda z: np.logaddexp(0, -z)
    for step in range(1, rounds + 1):
        gp, gu = positive @ w + b, unlabelled @ w + b
        negative = loss(-gu).mean() - prior * loss(-gp).mean()
        # derivatives of the mean losses by g, per row
        dp_plus, dp_minus, du_minus = -sigmoid(-gp) / len(gp), sigmoid(gp) / len(gp), sigmoid(gu) / len(gu)
        up = -prior * dp_minus
        if negative >= 0:
            rows_p, rows_u = prior * dp_plus + up, du_minus
        else:
            rows_p, rows_u = -up, -du_minus
        grad = np.append(rows_p @ positive + rows_u @ unlabelled + decay * w, rows_p.sum() + rows_u.sum())
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad ** 2
        move = rate * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.999 ** step)) + 1e-8)
        w, b = w - move[:-1], b - move[-1]
    return b, w


def _sample(rows: DataFrame, most: int) -> DataFrame:
    """Ids of the ``most`` rows of smallest id hash: a bounded sample that depends on the ids only."""
    return rows.select("doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)


def train(texts: DataFrame, positives: DataFrame, unlabelled: DataFrame, prior: float,
          most_positive: int = MOST_POSITIVE, most_unlabelled: int = MOST_UNLABELLED) -> Classifier:
    """A classifier from ``texts`` (doc_id, text) whose ids are in ``positives`` or ``unlabelled`` (doc_id).

    Without a positive or an unlabelled text, every score is ``prior``.
    """
    spark = texts.sparkSession
    chosen = _sample(positives, most_positive).withColumn("p", F.lit(True)) \
        .union(_sample(unlabelled, most_unlabelled).withColumn("p", F.lit(False)))
    rows = stored(texts.join(F.broadcast(chosen), "doc_id").select("p", "text"), "training")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = {kind: sketch.Counts() for kind in ("unlabelled", "positive", "texts")}
        words, texts = {"unlabelled": 0, "positive": 0}, {"unlabelled": 0, "positive": 0}
        for batch in batches:
            for p, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                cells, counts, n = cell_counts(text.as_buffer())
                kind = "positive" if p else "unlabelled"
                own[kind].counts[cells] += np.minimum(counts, MOST_COUNTED).astype(np.uint32)
                if p:
                    own["texts"].counts[cells] += 1
                words[kind] += min(n, MOST_WORDS)
                texts[kind] += 1
        part = [(kind, i, c, None, None) for kind, held in own.items() for i, c in held.slices()]
        part += [(kind, None, None, words[kind], texts[kind]) for kind in words]
        kinds = [pa.string(), pa.int32(), pa.binary(), pa.int64(), pa.int64()]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in part], k) for i, k in enumerate(kinds)],
                                         names=["kind", "slice", "counts", "words", "texts"])

    counted = stored(rows.mapInArrow(count, "kind string, slice int, counts binary, words long, texts long"), "training-counts")
    sizes = {r["kind"]: (r["w"], r["t"]) for r in counted.where("slice is null").groupBy("kind")
             .agg(F.sum("words").alias("w"), F.sum("texts").alias("t")).collect()}
    flat = Classifier(float(np.log(prior / (1 - prior))) if 0 < prior < 1 else (30.0 if prior >= 1 else -30.0),
                      np.zeros(1 << sketch.BITS, dtype=np.float32))
    if not all(sizes.get(k, (0, 0))[1] for k in ("positive", "unlabelled")) or not 0 < prior < 1:
        return flat
    in_p, in_u, texts_p = (sketch.total(counted.where(F.col("slice").isNotNull() & (F.col("kind") == kind)))
                           for kind in ("positive", "unlabelled", "texts"))
    expected = (in_u + 1.0) * sizes["positive"][0] / max(1, sizes["unlabelled"][0])
    excess = (in_p - expected) / np.sqrt(expected + 1)
    kept = np.flatnonzero((in_p >= LEAST_RATIO * expected) & (texts_p >= LEAST_TEXTS) & (excess >= EXCESS))
    if not len(kept):
        return flat
    shared = spark.sparkContext.broadcast(kept)

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = np.full(1 << sketch.BITS, -1, dtype=np.int32)
        place[shared.value] = np.arange(len(shared.value))
        for batch in sliced(batches):
            columns, sizes_of = [], []
            for text in batch.column(1):
                cells, counts, n = cell_counts(text.as_buffer())
                own = place[cells] >= 0
                columns.append(place[cells][own].astype("<i4").tobytes())
                sizes_of.append(values(counts, n)[own].astype("<f4").tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(columns, pa.binary()), pa.array(sizes_of, pa.binary())],
                                             names=["p", "cells", "values"])

    found = rows.mapInArrow(features, "p boolean, cells binary, values binary").collect()
    shared.destroy()

    def matrix(p: bool) -> SparseRows:
        own = [r for r in found if r["p"] == p]
        column = [np.frombuffer(r["cells"], dtype="<i4") for r in own]
        row = np.repeat(np.arange(len(own)), [len(c) for c in column])
        value = np.frombuffer(b"".join(r["values"] for r in own), dtype="<f4").astype(float)
        return SparseRows((len(own), len(kept)), row, np.concatenate(column), value)

    bias, weights = fit_nnpu(matrix(True), matrix(False), prior)
    flat.weights[kept] = weights
    return Classifier(bias, flat.weights)


def score(df: DataFrame, classifier: Classifier, text: str = "text", out: str = "score") -> DataFrame:
    """All columns of ``df`` and ``out``, the score of the whole text from 0 to 1; null and empty texts get the bias.

    A column named like ``out`` is replaced; repeated rows stay.
    """
    kept = [c for c in df.columns if c != out]
    source = df.select(*kept, df[text].alias("_text"))
    shared = df.sparkSession.sparkContext.broadcast(classifier)
    from pyspark.sql import types as T

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in sliced(batches):
            scores = [own.score(t.as_buffer()) for t in batch.column(len(kept))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:len(kept)], pa.array(scores, pa.float64())],
                                             names=[*kept, out])

    return source.mapInArrow(run, T.StructType([*(df.schema[c] for c in kept), T.StructField(out, T.DoubleType())]))


def held_out(doc_id: str = "doc_id"):
    """Rows that no label is learnt from: CRC-32 of the id as text leaves 1 when divided by 3; null ids are none."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def train_on_labels(docs: DataFrame, labels: DataFrame) -> Classifier:
    """A classifier for ``labels.toxic``, from rows that are not held out; labels that are null are no labels, and an id with
    contradicting labels is toxic.
    """
    known = labels.where(~held_out()).where("doc_id is not null and toxic is not null").groupBy("doc_id") \
        .agg(F.max("toxic").alias("toxic"))
    prior = known.agg(F.avg(F.col("toxic").cast("double")).alias("p")).first()["p"] or 0.0
    positives = known.where("toxic = 1")
    texts = docs.select("doc_id", "text").where(~held_out()).where("doc_id is not null")
    others = texts.select("doc_id").join(positives.select("doc_id"), "doc_id", "left_anti")
    return train(texts, positives, others, float(prior))
