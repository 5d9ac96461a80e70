"""Quality classifier: Naive Bayes support vectors over n-gram indicators.

Every text becomes the set of its byte n-grams, hashed into ``2 ** BITS``
features, together with the n-grams of the pattern "this word equals the one
before".  Each indicator is scaled by the log ratio of the smoothed class
frequencies (label 1 against label 0), and a linear hinge-loss model is fitted
over the scaled indicators by dual coordinate descent.  A logistic curve fitted
to the margins of the training rows turns a margin into a score from 0 to 1.

The fit sees a bounded sample of labelled rows, ``TRAIN_PER_CLASS`` of each
class at most, chosen by a hash of the id; that bound is a parameter.  Scoring
covers every row and the whole of each text.

Nulls, empties and the rest: a null text is scored as the empty text, whose
score is the model's prior; a null id is never held out nor trained on; rows
without a label (or a null one) are only scored; a document with several labels
trains once for each; repeated rows are scored each; with no or only one class
of labels every score is that class's share (0.5 without labels); an empty
table gives an empty table.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from verdatrace.llm.common import bytes_of, map_arrow, with_fields

#: Hashed features: 2 ** BITS.
BITS = 18
#: Lengths of the byte n-grams.
ORDERS = (1, 2, 3, 4)
#: Lengths of the n-grams of "this word equals the one before"; n has feature n.
REPEATS = (1, 2, 3, 5, 8)
#: Labelled rows of each class that the fit may see at most.
TRAIN_PER_CLASS = 3000
_ODD = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD)


def indicators(text: bytes, flags: np.ndarray) -> np.ndarray:
    """Ascending features of a text; ``flags`` is scratch space of 2 ** BITS zeros and is left so."""
    u = np.frombuffer(text, np.uint8)
    code = u.astype(np.uint64)
    for n in range(1, max(ORDERS) + 1):
        if n > 1:
            if len(u) < n:
                break
            code = (code[: len(u) - n + 1] << np.uint64(8)) | u[n - 1 :]
        if n in ORDERS:
            flags[((code + np.uint64(1)) * np.uint64(_ODD[n - 1])) >> np.uint64(64 - BITS)] = True
    words = text.split()
    same = bytes(map(eq, words, words[1:]))
    for n in REPEATS:
        if b"\x01" * n in same:
            flags[n] = True
    found = np.flatnonzero(flags)
    flags[found] = False
    return found.astype(np.int32)


@dataclass
class NBSVM:
    """Log-count ratios, weights of the scaled indicators, and the logistic curve over the margin."""

    ratios: np.ndarray
    weights: np.ndarray
    bias: float
    slope: float
    offset: float

    def margin(self, features: np.ndarray) -> float:
        scaled = self.ratios[features]
        return (float(self.weights[features] @ scaled) + self.bias) / float(np.sqrt(scaled @ scaled + 1.0))

    def probability(self, margin: float) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.slope * margin + self.offset, -500, 500))))


def constant(share: float) -> NBSVM:
    """The model when there is nothing to tell classes apart by."""
    share, none = min(max(share, 1e-6), 1 - 1e-6), np.zeros(1 << BITS)
    return NBSVM(none, none, 0.0, 0.0, float(np.log(share / (1 - share))))


def log_count_ratios(rows: list[np.ndarray], y: np.ndarray, smoothing: float) -> np.ndarray:
    """Log of the smoothed share of label-1 rows with an indicator against that of label-0 rows."""
    share = []
    for sign in (1, -1):
        of_class = [f for f, v in zip(rows, y, strict=True) if v == sign]
        counts = np.bincount(np.concatenate(of_class), minlength=1 << BITS)
        share.append((counts + smoothing) / (len(of_class) + 2 * smoothing))
    return np.log(share[0] / share[1])


def descend(rows: list[np.ndarray], values: list[np.ndarray], y: np.ndarray, cost: float, epochs: int, seed: int) -> tuple[np.ndarray, float]:
    """Dual coordinate descent for the hinge loss over unit-length rows; classes weigh alike."""
    w, b, alpha, order = np.zeros(1 << BITS), 0.0, np.zeros(len(rows)), np.random.default_rng(seed)
    upper = cost * np.where(y > 0, len(y) / (2 * np.sum(y > 0)), len(y) / (2 * np.sum(y < 0)))
    scale = np.array([1 / np.sqrt(v @ v + 1.0) for v in values])
    for _ in range(epochs):
        moved = 0.0
        for i in order.permutation(len(rows)):
            f, v, s = rows[i], values[i], scale[i]
            new = min(max(alpha[i] + 1 - y[i] * s * (w[f] @ v + b), 0.0), upper[i])
            if step := (new - alpha[i]) * y[i] * s:
                w[f] += step * v
                b += step
                moved, alpha[i] = max(moved, abs(new - alpha[i])), new
        if moved < 1e-4:
            break
    return w, b


def calibrate(margins: np.ndarray, y: np.ndarray, prior: float) -> tuple[float, float]:
    """Slope and offset of the logistic curve, by Newton's method; rows are weighted so that label 1 has the share ``prior``."""
    t, n1, n0 = y > 0, np.sum(y > 0), np.sum(y < 0)
    if not n1 or not n0:
        return 1.0, float(np.log(prior / (1 - prior)))
    weight = np.where(t, prior / n1, (1 - prior) / n0)
    x, theta = np.stack([margins, np.ones(len(margins))], 1), np.array([1.0, 0.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ theta, -50, 50)))
        gradient = x.T @ (weight * (p - t)) + 1e-4 * theta
        step = np.linalg.solve((x * (weight * p * (1 - p))[:, None]).T @ x + 1e-4 * np.eye(2), gradient)
        theta = theta - np.clip(step, -5, 5)
        if abs(step).max() < 1e-8:
            break
    return float(max(theta[0], 1e-3)), float(theta[1])


def fit(rows: list[np.ndarray], labels: np.ndarray, prior: float, smoothing: float = 1.0, cost: float = 1.0, epochs: int = 15, seed: int = 7) -> NBSVM:
    """Fit on the features of labelled rows; ``prior`` is the share of label 1 among all labelled rows.

    Every fifth row is kept from the descent, for the logistic curve.
    """
    y = np.where(labels > 0, 1, -1)
    kept = np.arange(len(y)) % 5 == 4
    if len(set(y[~kept])) < 2:
        return constant(prior)
    part = [f for f, k in zip(rows, kept, strict=True) if not k]
    ratios = log_count_ratios(part, y[~kept], smoothing)
    w, b = descend(part, [ratios[f] for f in part], y[~kept], cost, epochs, seed)
    model = NBSVM(ratios, w, b, 1.0, 0.0)
    margins = np.array([model.margin(f) for f, k in zip(rows, kept, strict=True) if k])
    model.slope, model.offset = calibrate(margins, y[kept], min(max(prior, 1e-6), 1 - 1e-6))
    return model


def held_out(key: Column, folds: int = 5) -> Column:
    """Whether a row may not be learned from: crc32 of the id as text, modulo ``folds``, is 0."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % folds == 0, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality", per_class: int = TRAIN_PER_CLASS) -> NBSVM:
    """Fit on at most ``per_class`` labelled rows of each class that are not held out."""
    known = labels.select(F.col(key).alias("_id"), (F.col(label) > 0).cast("int").alias("_label")).where(F.col("_id").isNotNull() & F.col("_label").isNotNull() & ~held_out(F.col("_id")))
    counts = {r["_label"]: r["count"] for r in known.groupBy("_label").count().collect()}
    if not counts:
        return constant(0.5)
    prior = counts.get(1, 0) / sum(counts.values())
    # Both parts have a fixed number of rows at most, whatever the input, so their broadcast is bounded.
    picked = [known.where(F.col("_label") == c).orderBy(F.xxhash64("_id"), "_id").limit(per_class) for c in (0, 1)]
    sample = docs.select(F.col(key).alias("_id"), F.col(text).alias("_text")).join(F.broadcast(picked[0].unionAll(picked[1])), "_id")

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        flags = np.zeros(1 << BITS, bool)
        made = [indicators(x, flags).tobytes() for x in bytes_of(batch.column(1))]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(made, pa.binary())], names=["_id", "_label", "_features"])

    table = map_arrow(sample.select("_id", "_text", "_label"), run, with_fields(sample.select("_id", "_label"), "_features binary")).toArrow()
    rows = sorted((zlib.crc32(str(i).encode()), str(i), c, f) for i, c, f in zip(*(x.to_pylist() for x in table.columns), strict=True))
    return fit([np.frombuffer(r[3], np.int32) for r in rows], np.array([r[2] for r in rows]), prior)


def score(docs: DataFrame, model: NBSVM, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key`` and ``score`` for every row; the model's size is fixed by BITS."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        flags, m = np.zeros(1 << BITS, bool), shared.value
        made = [m.probability(m.margin(indicators(x, flags))) for x in bytes_of(batch.column(1))]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made, pa.float64())], names=[key, "score"])

    return map_arrow(docs.select(key, text), run, f"{key} {docs.schema[key].dataType.simpleString()}, score double")


def keep_good(docs: DataFrame, model: NBSVM, threshold: float = 0.3, text: str = "text") -> DataFrame:
    """The rows of ``docs`` that score at least ``threshold``, with their columns as they were."""
    shared, place = docs.sparkSession.sparkContext.broadcast(model), docs.columns.index(text)

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        flags, m = np.zeros(1 << BITS, bool), shared.value
        yield batch.filter(pa.array([m.probability(m.margin(indicators(x, flags))) >= threshold for x in bytes_of(batch.column(place))], pa.bool_()))

    return map_arrow(docs, run, docs.schema)
