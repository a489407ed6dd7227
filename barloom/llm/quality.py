"""Quality classifier: naive Bayes support vectors.

Features are indicators of hashed n-grams: byte trigrams of the text, and trigrams of word
shapes (letters, capitals, digits and other characters in their order, and whether a word
repeats the one before).  Each indicator is scaled by the log ratio of its smoothed counts
in the two classes; rows are scaled to length one; a linear hinge-loss model is fitted by
dual coordinate descent; a sigmoid fitted on cross-validated margins gives scores.

The model is fitted in one task on a bounded sample of the labelled rows: those with the
smallest hash of their doc_id, at most ``train_rows`` of them and, in that order, up to
``train_bytes`` of their features (four bytes each, so that neither many nor very long texts
outgrow the task).  The model has a fixed size (two numbers a feature), so scoring is one
pass over the documents without a shuffle.  A word's shape names its first six runs of
kinds; what follows them is not part of the feature.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.llm.common import delete_table, written_at
from barloom.llm.textarrays import buffer_of, mix, slices, words

BITS = 18
#: Most labelled rows that the model is fitted on.
TRAIN_ROWS = 12000
#: Most bytes of features that the model is fitted on; by estimate the fit holds five times as much.
TRAIN_BYTES = 128 << 20
THRESHOLD = 0.3
SMOOTHING = 1.0
COST = 4.0
EPOCHS = 12
FIT_FOLDS = 4
#: One in so many doc_ids is held out, by a checksum.
FOLDS = 5

_KIND = np.full(256, 3, np.uint8)  # other characters
_KIND[ord("a") : ord("z") + 1] = 0
_KIND[ord("A") : ord("Z") + 1] = 1
_KIND[ord("0") : ord("9") + 1] = 2
_KIND[128:] = 0


def held_out(doc_id: Column) -> Column:
    """Rows whose labels are never learned from; a null doc_id is one of them."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % FOLDS == 0, F.lit(True))


def _shapes(part: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A code for each word and the text it is in: its kinds of characters, each named
    once per run and up to six runs, and whether the word before is the same."""
    start, end, doc = words(part, off)
    if not len(start):
        return np.zeros(0, np.uint64), doc
    kind = _KIND[part].astype(np.uint64)
    turn = np.ones(len(part), bool)
    turn[1:] = kind[1:] != kind[:-1]
    turn[start] = True
    inside = np.zeros(len(part), np.int64)
    inside[start] = np.arange(len(start)) + 1
    word = np.maximum.accumulate(inside) - 1
    at = np.flatnonzero(turn & (word >= 0))
    w = word[at]
    keep = at < end[w]
    at, w = at[keep], w[keep]
    first = np.searchsorted(w, np.arange(len(start)))
    k = np.arange(len(at)) - first[w]
    few = k < 6
    code = np.bincount(w[few], weights=((kind[at] + np.uint64(1)) * np.uint64(5) ** k.astype(np.uint64))[few].astype(float), minlength=len(start)).astype(np.uint64)
    same = np.zeros(len(start), bool)
    length = end - start
    maybe = np.flatnonzero((length[1:] == length[:-1]) & (doc[1:] == doc[:-1])) + 1
    for n in np.unique(length[maybe]):
        own = maybe[length[maybe] == n]
        many = max(1, (1 << 18) // int(n))
        for lo in range(0, len(own), many):
            few_own = own[lo : lo + many]
            span = np.arange(n)
            same[few_own] = (part[start[few_own][:, None] + span] == part[start[few_own - 1][:, None] + span]).all(axis=1)
    return code * np.uint64(2) + same, doc


def features(texts: pa.Array, bits: int = BITS) -> Iterator[np.ndarray]:
    """The sorted distinct features of each text."""
    buf, offsets = buffer_of(texts)
    shift = np.uint64(64 - bits)
    for i, j in slices(offsets):
        part, off = buf[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        code, doc = _shapes(part, off)
        cut = np.searchsorted(doc, np.arange(j - i + 1))
        wide = part.astype(np.uint64)
        grams = (mix((wide[:-2] << np.uint64(16) | wide[1:-1] << np.uint64(8) | wide[2:]) + np.uint64(1)) >> shift).astype(np.int32) if len(part) > 2 else np.zeros(0, np.int32)
        shapes = (mix((code[:-2] << np.uint64(40)) + (code[1:-1] << np.uint64(20)) + code[2:] + np.uint64(1 << 62)) >> shift).astype(np.int32) if len(code) > 2 else np.zeros(0, np.int32)
        for k in range(j - i):
            yield np.unique(np.concatenate([grams[off[k] : max(off[k], off[k + 1] - 2)], shapes[cut[k] : max(cut[k], cut[k + 1] - 2)]]))


@dataclass(frozen=True)
class Model:
    """Weights with the ratios multiplied in, squared ratios, and the sigmoid."""

    weights: np.ndarray
    squares: np.ndarray
    slope: float
    offset: float

    def margin(self, x: np.ndarray) -> float:
        norm = math.sqrt(float(self.squares[x].sum()))
        return float(self.weights[x].sum()) / norm if norm else 0.0

    def score(self, x: np.ndarray) -> float:
        z = self.slope * self.margin(x) + self.offset
        return 1 / (1 + math.exp(-z)) if z > -700 else 0.0


def log_ratios(rows: list[np.ndarray], y: np.ndarray, n: int, smoothing: float = SMOOTHING) -> np.ndarray:
    """log of (smoothed share of a feature among class 1) over (that among class 0)."""
    counts = [np.bincount(np.concatenate([np.zeros(0, np.int32), *(r for r, c in zip(rows, y, strict=True) if c == k)]), minlength=n) + smoothing for k in (0, 1)]
    return np.log(counts[1] / counts[1].sum()) - np.log(counts[0] / counts[0].sum())


def dual_descent(rows: list[np.ndarray], values: list[np.ndarray], y: np.ndarray, n: int, cost: float, epochs: int, seed: int = 1) -> np.ndarray:
    """Weights that minimise |w|^2/2 + cost * sum of hinge losses over rows of length one."""
    rng, w, alpha = np.random.default_rng(seed), np.zeros(n), np.zeros(len(rows))
    sign = np.where(y == 1, 1.0, -1.0)
    q = np.array([float((v * v).sum()) for v in values])
    for _ in range(epochs):
        most = 0.0
        for i in rng.permutation(len(rows)):
            if not q[i]:
                continue
            x, v, s = rows[i], values[i], sign[i]
            gradient = s * float(w[x] @ v) - 1
            new = min(max(alpha[i] - gradient / q[i], 0.0), cost)
            step = new - alpha[i]
            if step:
                w[x] += step * s * v
                alpha[i] = new
                most = max(most, abs(step))
        if most < 1e-3 * cost:
            break
    return w


def sigmoid(margins: np.ndarray, y: np.ndarray, rounds: int = 100) -> tuple[float, float]:
    """Slope and offset by Newton's method on smoothed targets; the slope is not negative."""
    pos, neg = int((y == 1).sum()), int((y == 0).sum())
    target = np.where(y == 1, (pos + 1) / (pos + 2), 1 / (neg + 2))
    a, b = 1.0, math.log((pos + 1) / (neg + 1))
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(a * margins + b, -500, 500)))
        g = np.array([((p - target) * margins).sum(), (p - target).sum()])
        h = p * (1 - p)
        m = np.array([[(h * margins * margins).sum() + 1e-9, (h * margins).sum()], [(h * margins).sum(), h.sum() + 1e-9]])
        step = np.linalg.solve(m, g)
        size = min(1.0, 4.0 / (1e-12 + np.abs(step).max()))
        a, b = a - size * step[0], b - size * step[1]
        if np.abs(step).max() < 1e-8:
            break
    return max(float(a), 0.0), float(b)


def _linear(rows: list[np.ndarray], y: np.ndarray, n: int, cost: float, epochs: int) -> Model:
    ratio = log_ratios(rows, y, n)
    values = []
    for r in rows:
        v = ratio[r]
        norm = math.sqrt(float((v * v).sum()))
        values.append(v / norm if norm else v)
    w = dual_descent(rows, values, y, n, cost, epochs)
    return Model((w * ratio).astype(np.float32), (ratio * ratio).astype(np.float32), 1.0, 0.0)


def fit(rows: list[np.ndarray], y: np.ndarray, bits: int = BITS, cost: float = COST, epochs: int = EPOCHS, folds: int = FIT_FOLDS) -> Model:
    """The model of all rows; the sigmoid is fitted on margins that each row gets from a
    model of the other folds.  Without rows of both classes the score is the smoothed share
    of class 1, and 1 without any rows."""
    n = 1 << bits
    fold = np.empty(len(y), int)
    for c in (0, 1):  # each fold has its share of either class
        own = np.flatnonzero(y == c)
        fold[own] = np.arange(len(own)) % folds
    if min((y == 1).sum(), (y == 0).sum()) < 2:
        share = (y.sum() + 1) / (len(y) + 1)
        return Model(np.zeros(n, np.float32), np.zeros(n, np.float32), 0.0, math.log(share / (1 - share)) if share < 1 else 700.0)
    margins = np.empty(len(y))
    for k in range(folds):
        other = _linear([r for r, f in zip(rows, fold, strict=True) if f != k], y[fold != k], n, cost, epochs)
        for i in np.flatnonzero(fold == k):
            margins[i] = other.margin(rows[i])
    slope, offset = sigmoid(margins, y)
    model = _linear(rows, y, n, cost, epochs)
    return Model(model.weights, model.squares, slope, offset)


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", train_rows: int = TRAIN_ROWS, bits: int = BITS, train_bytes: int = TRAIN_BYTES) -> Model:
    """The model of ``docs`` (doc_id, text) and ``labels`` (doc_id and 0 or 1).

    Rows without a doc_id or label, held-out rows, and documents that are labelled both
    ways teach nothing; repeated rows of a document teach once.  The first document in order
    of hashes that would take the features above ``train_bytes`` teaches nothing, nor do
    those after it.  Without documents or labels the model is that of no rows.
    """
    ids = labels.select("doc_id", F.col(label).alias("y")).where("doc_id is not null and y in (0, 1)").where(~held_out(F.col("doc_id")))
    ids = ids.groupBy("doc_id").agg(F.min("y").alias("y"), F.max("y").alias("y2")).where("y = y2").drop("y2")
    # At most train_rows rows, whatever the input: small enough to send to every task.
    chosen = ids.orderBy(F.xxhash64("doc_id"), "doc_id").limit(train_rows)
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = pa.array([r.astype("<i4").tobytes() for r in features(b.column("text"), bits)], pa.binary())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("y").cast(pa.int32()), x], names=["doc_id", "y", "x"])

    def learn(table: pa.Table) -> pa.Table:
        table = table.sort_by("doc_id")
        own = [np.frombuffer(x, "<i4") for x in table.column("x").to_pylist()]
        m = fit(own, table.column("y").to_numpy(), bits)
        return pa.table({"weights": pa.array([m.weights.tobytes()], pa.binary()), "squares": pa.array([m.squares.tobytes()], pa.binary()), "slope": [m.slope], "offset": [m.offset]})

    taught = rows.mapInArrow(extract, "doc_id long, y int, x binary").groupBy("doc_id").agg(F.max(F.struct("x", "y")).alias("r"))
    at, taught = written_at(taught)
    # Two numbers of each of at most train_rows rows: one task holds them all.
    sizes = taught.select("doc_id", F.sum(F.octet_length("r.x")).over(Window.orderBy(F.xxhash64("doc_id"), "doc_id")).alias("until"))
    taught = taught.join(F.broadcast(sizes.where(F.col("until") <= train_bytes).select("doc_id")), "doc_id", "left_semi")
    learned = taught.select("doc_id", "r.x", "r.y").groupBy(F.lit(0).alias("all")).applyInArrow(learn, "weights binary, squares binary, slope double, offset double").first()
    delete_table(docs.sparkSession, at)
    if learned is None:
        return fit([], np.zeros(0, int), bits)
    return Model(np.frombuffer(bytes(learned["weights"]), np.float32), np.frombuffer(bytes(learned["squares"]), np.float32), learned["slope"], learned["offset"])


def score_texts(docs: DataFrame, model: Model, bits: int = BITS) -> DataFrame:
    """doc_id and score of every row; null and empty texts have the score of no features.

    Texts may be of any length: features are taken of whole texts, and a text has at most
    ``2 ** bits`` of them.  Equal texts have equal scores, repeated rows each their own; other
    columns are ignored; an empty table gives no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([m.score(x) for x in features(b.column("text"), bits)], pa.float64())], names=["doc_id", "score"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, score double")


def classify(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, **how) -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, score, predicted.

    Only doc_id and text are read of ``docs``, and only the text is scored: columns of
    ``docs`` that are called like those of the result do not matter.  Null and empty texts
    have the score of no features, very long ones that of the whole text; repeated rows stay
    repeated, and a null doc_id is held out; an empty table gives no rows.
    """
    scored = score_texts(docs, train(docs, labels, **how))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, **how) -> DataFrame:
    """The rows of ``docs`` that the classifier does not reject, with all their columns,
    whatever their names.

    Rows are judged one by one by their whole text, null like empty: repeated rows stay or go
    together, rows without a doc_id are judged too, and an empty table gives no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(train(docs, labels, **how))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in batches:
            at = [k for k, x in enumerate(features(b.column("text"))) if m.score(x) >= threshold]
            yield b.take(pa.array(at, pa.int64()))

    return docs.mapInArrow(run, docs.schema)
