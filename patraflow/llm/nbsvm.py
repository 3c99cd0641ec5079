"""Quality classifier: Naive Bayes support vectors.

Features are indicators of n-grams: byte 3-grams of the text as it is, words and pairs of words, each of these three hashed to its own 2**16,
and n-grams of one word repeated, of 2, 3, 5 or 9 words. Each indicator is scaled by its class log-count ratio; a linear hinge-loss model on the scaled indicators is
fitted by dual coordinate descent. Two half-fits score each other's rows, and a logistic curve through these margins, weighted to the
classes' true counts, turns margins into probabilities.

The bound of the fit: `per_class` sampled labelled rows a class, by hash of the id. Fit and scores read whole texts, however long.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _text as X
from .langid import held_out

GRAMS, RUNS = 1 << 16, (2, 3, 5, 9)
WIDTH = 3 * GRAMS + len(RUNS)
ROWS = 64


@dataclass(frozen=True)
class QualityModel:
    """A weight for each feature, a bias, and the logistic curve's slope and shift."""

    weights: np.ndarray
    bias: float
    slope: float
    shift: float


def features(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (row, feature) pairs, by row."""
    rows, cols = [], []
    n = len(at) - 1
    b = data.astype(np.uint32)
    gram = ((b[:-2] | b[1:-1] << 8 | b[2:] << 16) * np.uint32(0x9E3779B1) >> 16).astype(np.int64) if len(b) > 2 else np.zeros(0, np.int64)
    starts, ends, first = X.words(data, at)
    h = X.word_hashes(data, starts, ends)
    shift = X.U(48)
    word = (h >> shift).astype(np.int64) + GRAMS
    pair = (X.joined(h[:-1], h[1:]) >> shift).astype(np.int64) + 2 * GRAMS
    same = np.zeros(len(h), np.int64)
    same[1:] = h[1:] == h[:-1]
    same[first[:-1][first[:-1] < len(h)]] = 0
    fresh = np.flatnonzero(same == 0)
    length = np.diff(np.append(fresh, len(h)))
    owner = np.searchsorted(first, fresh, "right") - 1
    for i in range(0, n, ROWS):
        j = min(i + ROWS, n)
        seen = np.zeros((j - i, WIDTH), bool)
        for r in range(i, j):
            seen[r - i, gram[at[r] : max(at[r], at[r + 1] - 2)]] = True
            seen[r - i, word[first[r] : first[r + 1]]] = True
            seen[r - i, pair[first[r] : max(first[r], first[r + 1] - 1)]] = True
        part = slice(*np.searchsorted(owner, [i, j]))
        for k, run in enumerate(RUNS):
            seen[owner[part][length[part] >= run] - i, 3 * GRAMS + k] = True
        cell = np.flatnonzero(seen.ravel())
        rows.append(cell // WIDTH + i)
        cols.append(cell % WIDTH)
    none = np.zeros(0, np.int64)
    return np.concatenate([none, *rows]), np.concatenate([none, *cols])


def _features(batches):
    for batch in batches:
        for part, data, at in X.groups(batch, "text"):
            row, col = features(data, at)
            edge = np.searchsorted(row, np.arange(len(at))).astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column(0)[part], pa.ListArray.from_arrays(edge, pa.array(col.astype(np.int32)))], ["label", "cols"])


def log_ratios(sets: list[np.ndarray], y: np.ndarray, alpha: float = 1.0) -> np.ndarray:
    p, q = (alpha + np.bincount(np.concatenate([np.zeros(0, np.int64), *(s for s, v in zip(sets, y, strict=True) if v == sign)]), minlength=WIDTH) for sign in (1, -1))
    return np.log(p / p.sum()) - np.log(q / q.sum())


def dual_descent(sets: list[np.ndarray], r: np.ndarray, y: np.ndarray, c: float, epochs: int = 20, seed: int = 7) -> tuple[np.ndarray, float]:
    """Weights on the scaled features and the bias of the L2-regularised hinge-loss model, by dual coordinate descent."""
    values = [r[s] for s in sets]
    norm = np.array([v @ v + 1 for v in values])
    a, w, bias = np.zeros(len(y)), np.zeros(WIDTH), 0.0
    order = np.arange(len(y))
    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        rng.shuffle(order)
        most = 0.0
        for i in order.tolist():
            s, v = sets[i], values[i]
            g = y[i] * (w[s] @ v + bias) - 1
            new = min(max(a[i] - g / norm[i], 0.0), c)
            if (d := new - a[i]) != 0.0:
                w[s] += d * y[i] * v
                bias += d * y[i]
                a[i] = new
                most = max(most, abs(d))
        if most < 1e-3 * c:
            break
    return w, bias


def logistic(margin: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Slope and shift of the logistic curve, by Newton steps with a small penalty."""
    x = np.stack([margin, np.ones(len(margin))], 1)
    t, beta = (y > 0).astype(float), np.array([1.0, 0.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        g = x.T @ (weight * (p - t)) + 1e-3 * beta
        step = np.linalg.solve((x * (weight * p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(2), g)
        beta = beta - step * min(1, 5 / max(1e-9, np.abs(step).max()))
        if np.abs(step).max() < 1e-6:
            break
    return float(beta[0]), float(beta[1])


def fit(docs: DataFrame, labels: DataFrame, label_col: str = "quality", id_col: str = "doc_id", text_col: str = "text", per_class: int = 3000, c: float = 0.02) -> QualityModel | None:
    """Learns from labelled rows of docs; null labels are left out. None if a class has no row."""
    known = labels.select(F.col(id_col).alias("id"), (F.col(label_col) > 0).cast("int").alias("label")).where("label is not null and id is not null")
    known = known.withColumn("key", F.xxhash64(F.col("id").cast("string")))
    total = {r["label"]: r["n"] for r in known.groupBy("label").agg(F.count("*").alias("n")).collect()}
    picked = known.groupBy("label", F.pmod("key", F.lit(per_class)).alias("slot")).agg(F.min("key").alias("key")).select("label", "key")
    text = docs.select(F.xxhash64(F.col(id_col).cast("string")).alias("key"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    rows = text.join(F.broadcast(picked), "key").groupBy("label", "key").agg(F.min("text").alias("text"))  # per_class rows a class
    table = rows.select("label", "text").mapInArrow(_features, "label int, cols array<int>").toArrow()
    found = sorted(((k, c.values.to_numpy(zero_copy_only=False)) for k, c in zip(table["label"].to_pylist(), table["cols"], strict=True)), key=lambda x: (x[0], len(x[1]), x[1].tobytes()))
    sets, y = [s for _, s in found], np.array([1 if v else -1 for v, _ in found])
    if min((y > 0).sum(), (y < 0).sum()) < 2:
        return None
    margin = np.zeros(len(y))
    for half in (0, 1):
        train = np.arange(len(y)) % 2 != half
        own = [s for s, t in zip(sets, train, strict=True) if t]
        r = log_ratios(own, y[train])
        w, bias = dual_descent(own, r, y[train], c)
        for i in np.flatnonzero(~train):
            margin[i] = (w * r)[sets[i]].sum() + bias
    weight = np.where(y > 0, total[1] / (y > 0).sum(), total[0] / (y < 0).sum())
    slope, shift = logistic(margin, y, weight / weight.mean())
    r = log_ratios(sets, y)
    w, bias = dual_descent(sets, r, y, c)
    return QualityModel(w * r, bias, slope, shift)


def scores(docs: DataFrame, model: QualityModel | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row (doc_id, score) per row of docs; null texts count as empty. Without a model each score is 0.5."""
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    if model is None:
        return rows.select("doc_id", F.lit(0.5).alias("score"))

    def run(batches):
        for batch in batches:
            for part, data, at in X.groups(batch, "text"):
                row, col = features(data, at)
                margin = np.bincount(row, model.weights[col], len(at) - 1) + model.bias
                p = 1 / (1 + np.exp(-np.clip(model.slope * margin + model.shift, -30, 30)))
                yield pa.RecordBatch.from_arrays([batch.column(0)[part], pa.array(p)], ["doc_id", "score"])

    return rows.mapInArrow(run, f"doc_id {kind}, score double")


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Fits on labels of rows that are not held out and scores every row: doc_id, held_out, score, predicted (1 from a score of 0.7)."""
    model = fit(docs, labels.where(~held_out()))
    return scores(docs, model).select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))
