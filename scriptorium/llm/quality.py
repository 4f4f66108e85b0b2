"""Quality classifier: naive Bayes features in a linear support vector machine.

Indicators of hashed n-grams (character trigrams, words and word pairs) are
scaled by the log ratio of their shares in the two classes; a linear hinge-loss
model is fitted to the scaled rows by dual coordinate descent, and its margins
are turned into probabilities on rows kept out of the fit.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches
from .shingles import U64, mix, text_slices, words

#: Labelled rows that the fit reads at most, those with the least hash of the id.
SAMPLE_ROWS = 12_000
#: Hashed features: 8 bytes each, whatever the input.
DIMENSIONS = 1 << 18
EPOCHS = 8
COST = 1.0


def features(column: pa.Array):
    """Row after row, the sorted distinct features of each text (lower-cased A-Z)."""
    for _, data, offsets in text_slices(column):
        rows = len(offsets) - 1
        low = np.where((data >= 65) & (data <= 90), data + np.uint8(32), data).astype(U64)
        h, at = words(data, offsets)
        owner = np.repeat(np.arange(rows), np.diff(at))
        parts = [(owner, mix(h + U64(1)))]
        if len(h) > 1:
            same = owner[1:] == owner[:-1]
            parts.append((owner[1:][same], mix(h[:-1][same] * U64(0x9E3779B97F4A7C15) + h[1:][same])))
        if len(low) > 2:
            at_byte = np.repeat(np.arange(rows), np.diff(offsets))
            same = at_byte[2:] == at_byte[:-2]
            parts.append((at_byte[2:][same], mix((low[:-2] << U64(16) | low[1:-1] << U64(8) | low[2:])[same])))
        key = np.concatenate([o.astype(np.int64) * DIMENSIONS + (f & U64(DIMENSIONS - 1)).astype(np.int64) for o, f in parts])
        key.sort()
        key = key[np.r_[True, key[1:] != key[:-1]]] if len(key) else key
        yield rows, key // DIMENSIONS, key % DIMENSIONS


class QualityModel:
    """Weights of the scaled features and the two numbers that turn margins into probabilities."""

    def __init__(self, ratio: np.ndarray, weight: np.ndarray, bias: float, slope: float, shift: float):
        self.ratio, self.weight, self.bias, self.slope, self.shift = ratio, weight, bias, slope, shift

    def scores(self, column: pa.Array) -> np.ndarray:
        out = []
        for rows, owner, f in features(column):
            r = self.ratio[f]
            norm = np.sqrt(np.bincount(owner, r * r, rows))
            margin = np.bincount(owner, r * self.weight[f], rows) / np.maximum(norm, 1e-12) + self.bias
            out.append(1 / (1 + np.exp(-np.clip(self.slope * margin + self.shift, -50, 50))))
        return np.concatenate(out) if out else np.zeros(0)


def _descend(rows: list[np.ndarray], values: list[np.ndarray], y: np.ndarray, cost: np.ndarray, rng) -> tuple[np.ndarray, float]:
    """Hinge-loss weights by dual coordinate descent; the bias is a constant feature of 1."""
    w, b, alpha = np.zeros(DIMENSIONS), 0.0, np.zeros(len(rows))
    square = np.array([v @ v + 1 for v in values])
    for _ in range(EPOCHS):
        for i in rng.permutation(len(rows)):
            f, v = rows[i], values[i]
            g = y[i] * (w[f] @ v + b) - 1
            new = min(max(alpha[i] - g / square[i], 0.0), cost[i])
            if new != alpha[i]:
                step = (new - alpha[i]) * y[i]
                w[f] += step * v
                b += step
                alpha[i] = new
    return w, b


def _platt(margin: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and shift of the logistic curve of least loss, by Newton steps."""
    a, b = 1.0, 0.0
    up, down = (y > 0).sum(), (y <= 0).sum()
    target = np.where(y > 0, (up + 1) / (up + 2), 1 / (down + 2))
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * margin + b, -50, 50)))
        d, h = p - target, np.maximum(p * (1 - p), 1e-9)
        g = np.array([d @ margin, d.sum()])
        hess = np.array([[h @ (margin * margin) + 1e-6, h @ margin], [h @ margin, h.sum() + 1e-6]])
        step = np.linalg.solve(hess, g)
        a, b = a - step[0], b - step[1]
        if np.abs(step).max() < 1e-8:
            break
    return (float(a), float(b)) if a > 0 else (0.0, float(np.log((up + 1) / (down + 1))))


def fit(rows: list[np.ndarray], label: np.ndarray, seed: int = 7) -> QualityModel:
    """Fit on sorted feature rows and labels 0 or 1. One class only gives its share everywhere."""
    up, down = int((label == 1).sum()), int((label == 0).sum())
    if not up or not down:
        return QualityModel(np.zeros(DIMENSIONS), np.zeros(DIMENSIONS), 0.0, 0.0, float(np.log((up + 1) / (down + 1))))
    counts = [np.ones(DIMENSIONS), np.ones(DIMENSIONS)]
    for f, y in zip(rows, label, strict=True):
        counts[int(y)][f] += 1
    ratio = np.log(counts[1] / counts[1].sum()) - np.log(counts[0] / counts[0].sum())
    ratio[(counts[0] + counts[1]) <= 3] = 0.0  # met once at most
    values = []
    for f in rows:
        r = ratio[f]
        values.append(r / max(1e-12, np.sqrt(r @ r)))
    y = np.where(label == 1, 1.0, -1.0)
    cost = np.where(y > 0, COST * len(y) / (2 * up), COST * len(y) / (2 * down))
    rng = np.random.default_rng(seed)
    fold = rng.permutation(len(rows)) % 5 == 0
    margin = np.zeros(len(rows))
    kept = np.flatnonzero(~fold) if len(set(label[~fold])) == 2 and fold.any() else np.arange(len(rows))
    out = np.flatnonzero(fold) if len(kept) < len(rows) else kept
    w, b = _descend([rows[i] for i in kept], [values[i] for i in kept], y[kept], cost[kept], rng)
    for i in out:
        margin[i] = w[rows[i]] @ values[i] + b
    slope, shift = _platt(margin[out], y[out])
    return QualityModel(ratio, w, b, slope, shift)


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample_rows: int = SAMPLE_ROWS) -> QualityModel:
    """Fit on the labelled documents: at most ``sample_rows`` labels, those with the least hash of the id.

    Labels other than 0 and 1 and null ids are left out.  Only the chosen rows'
    features reach the driver.  Without labels every score is one half.
    """
    chosen = labels.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("int").alias("y")).where("id is not null and y in (0, 1)").orderBy(F.xxhash64("id"), "y").limit(sample_rows)
    chosen = docs.sparkSession.createDataFrame(chosen.toPandas(), "id long, y int")
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))

    def run(batches):
        for batch in batches:
            found, bounds = [], [0]
            for rows, owner, f in features(batch.column("text")):
                bounds += (bounds[-1] + np.cumsum(np.bincount(owner, minlength=rows))).tolist()
                found.append(f.astype(np.int32))
            if len(bounds) > 1:
                yield pa.record_batch([batch.column("y"), pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(np.concatenate(found)))], names=["y", "f"])

    table = texts.join(F.broadcast(chosen), "id").select("y", "text").mapInArrow(run, "y int, f array<int>").toArrow()
    rows = [np.asarray(x.values) for x in table.column("f")]
    return fit(rows, table.column("y").to_numpy())


def score(docs: DataFrame, model: QualityModel, text_col: str = "text", out_col: str = "score") -> DataFrame:
    """``docs`` with ``out_col``: the probability of label 1, for empty and null texts too. ``out_col`` must be a new name."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(text: pd.Series) -> pd.Series:
        return pd.Series(shared.value.scores(pa.array(text, pa.string(), from_pandas=True)))

    return docs.withColumn(out_col, F.pandas_udf(run, "double")(F.col(text_col).cast("string")))
