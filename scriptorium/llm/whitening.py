"""Whitening of embeddings by cyclic Jacobi rotations.

The centred scatter matrix is summed by Spark from the distinct vectors; its order
is the number of dimensions, so the driver can hold it.  There, rotations by
disjoint pairs of axes, every pair once a sweep, go on until what stands off the
diagonal vanishes against the diagonal; small eigenvalues come out as
accurate as large ones.  The sorted axes over their roots go to all rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize

SCALE, SHIFT = 64, 1_000_000
#: Scaled entries beyond this are held at it, so that they stay exact as doubles.
LARGEST = 1 << 52
COMPONENTS = 16


def jacobi(matrix: np.ndarray, sweeps: int = 60) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, falling, and unit eigenvectors (columns) of a symmetric matrix; each column's largest entry is positive.

    A sweep goes through all pairs of axes in rounds of disjoint pairs, as in a
    tournament.  It ends when no pair's entry counts beside the two entries of
    the diagonal; ``sweeps`` only guards against matrices that aren't finite.
    """
    d = len(matrix)
    a, v = matrix.astype(np.float64).copy(), np.eye(d)
    ring = [*range(d), *([-1] * (d % 2))]
    tiny = np.finfo(np.float64).eps
    floor = tiny * tiny * max(float(np.abs(np.diag(a)).max(initial=0.0)), np.finfo(np.float64).tiny)
    for _ in range(sweeps):
        turned = False
        for _ in range(len(ring) - 1):
            pairs = [(min(x, y), max(x, y)) for x, y in zip(ring[: len(ring) // 2], ring[: len(ring) // 2 - 1 : -1], strict=True) if x >= 0 and y >= 0]
            ring = [ring[0], ring[-1], *ring[1:-1]]
            p, q = np.array(pairs, np.int64).reshape(-1, 2).T
            off = a[p, q]
            live = np.abs(off) > np.maximum(tiny * np.sqrt(np.abs(a[p, p] * a[q, q])), floor)
            if not live.any():
                continue
            turned = True
            p, q, off = p[live], q[live], off[live]
            theta = (a[q, q] - a[p, p]) / (2 * off)
            t = np.where(theta >= 0, 1.0, -1.0) / (np.abs(theta) + np.hypot(theta, 1.0))
            c = 1 / np.hypot(t, 1.0)
            s = t * c
            diagonal = a[p, p] - t * off, a[q, q] + t * off
            for m in (a, v):
                left, right = m[:, p].copy(), m[:, q]
                m[:, p], m[:, q] = c * left - s * right, s * left + c * right
            upper, lower = a[p].copy(), a[q]
            a[p], a[q] = c[:, None] * upper - s[:, None] * lower, s[:, None] * upper + c[:, None] * lower
            a[p, q] = a[q, p] = 0.0
            a[p, p], a[q, q] = diagonal
        if not turned:
            break
    values = np.diag(a).copy()
    order = np.argsort(-values, kind="stable")
    v = v[:, order]
    signs = np.sign(v[np.abs(v).argmax(axis=0), np.arange(d)]) if d else np.ones(0)
    return values[order], v * np.where(signs == 0, 1.0, signs)


def _matrix(column: pa.Array, d: int) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, d)


def exact_offsets(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """``n * x - sums`` exactly: 64-bit numbers where they suffice, Python's own elsewhere."""
    if n * int(np.abs(x).max(initial=0)) + max(map(abs, sums), default=0) < 1 << 62:
        return x * np.int64(n) - np.array(sums, np.int64)
    return x.astype(object) * n - np.array(sums, object)


def squares(t: np.ndarray) -> list[int | None]:
    """The exact sum of squares of each row; null where it needs more than 64 bits."""
    if t.dtype != object and t.shape[1] * max(1, int(np.abs(t).max(initial=0))) ** 2 < 1 << 63:
        return (t * t).sum(axis=1).tolist()
    return [s if (s := sum(int(y) ** 2 for y in row)) < 1 << 63 else None for row in t.tolist()]


def _added(parts: DataFrame, kind: str) -> dict[int, np.ndarray]:
    """Sums of the arrays ``v`` by ``i``; each task adds up what it reads, and the driver gets one array for each ``i``."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for b in batches:
            for i, v in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                v = v.values.to_numpy(zero_copy_only=False)
                held[i] = held[i] + v if i in held else v
        yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.int32()), pa.array([v.tolist() for v in held.values()], pa.list_(pa.int64() if kind == "bigint" else pa.float64()))], ["i", "v"])

    rows = parts.repartition("i").mapInArrow(add, f"i int, v array<{kind}>").collect()
    return {r["i"]: np.array(r["v"]) for r in rows}


def _parts(fit: DataFrame, d: int, make, kind: str) -> dict[int, np.ndarray]:
    """Sums over ``fit`` of the arrays that ``make`` gives for the matrix of each batch, added up within a task first."""

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for b in batches:
            if b.num_rows:
                made = make(_matrix(b.column(0), d))
                held = made if held is None else [x + y for x, y in zip(held, made, strict=True)]
        if held is not None:
            yield pa.RecordBatch.from_arrays([pa.array(range(len(held)), pa.int32()), pa.array([np.asarray(v).tolist() for v in held], pa.list_(pa.int64() if kind == "bigint" else pa.float64()))], ["i", "v"])

    return _added(fit.select("x").mapInArrow(part, f"i int, v array<{kind}>"), kind)


def scaled(vectors: DataFrame, id_col: str, vector_col: str) -> tuple[DataFrame, int]:
    """``id, x`` of the rows that take part, and their number of dimensions."""
    entries = F.col(vector_col).cast("array<double>")
    rows = vectors.select(F.col(id_col).alias("id"), entries.alias("v")).where(F.col("v").isNotNull() & (F.size("v") > 0) & ~F.exists("v", lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf"))))
    most = rows.groupBy(F.size("v").alias("d")).agg(F.count(F.lit(1)).alias("rows")).orderBy(F.desc("rows"), F.desc("d")).first()
    d = most["d"] if most else 0
    held = lambda c: F.greatest(F.least(F.lit(SCALE) * c, F.lit(float(LARGEST))), F.lit(float(-LARGEST)))
    return rows.where(F.size("v") == d).select("id", F.transform("v", lambda c: F.floor(held(c)) + F.lit(SHIFT).cast("bigint")).alias("x")), d


def whiten(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """``id, n, deviation, whitened, explained, identity_error``: one row for each vector, with an array of its components.

    Rows without a vector, or with null or non-finite entries, take no part, nor
    do empty vectors and those of another length than most (of equally many
    lengths the largest counts).  Each entry becomes ``floor(64 * c) + 1000000``.  The
    fit is over the distinct vectors, so copies weigh nothing.  ``n`` is their
    number; ``deviation`` the exact sum of ``(n * x - S) ** 2`` over the dimensions (null if it
    needs more than 64 bits); ``whitened`` and ``explained`` are arrays by falling
    eigenvalue, ``identity_error`` the largest absolute entry of the whitened vectors'
    covariance less the identity, over the components that vary.  A component
    without variance (as with one distinct vector, or copied dimensions) is null in
    ``whitened`` and 0 in ``explained``.  Repeated rows come out as often as they
    came in; an empty table gives an empty result.
    """
    spark = vectors.sparkSession
    rows, d = scaled(vectors, id_col, vector_col)
    kind = "id " + rows.schema["id"].dataType.simpleString() + ", n bigint, deviation bigint, whitened array<double>, explained array<double>, identity_error double"
    fit = materialize(rows.select("x").distinct(), "fit") if d else None
    n = fit.count() if d else 0
    if not n:
        return spark.createDataFrame([], kind)
    sums = [int(s) for s in _parts(fit, d, lambda x: [x.sum(axis=0)], "bigint")[0]]

    def centred(x: np.ndarray) -> np.ndarray:
        return (exact_offsets(x, n, sums) / n).astype(np.float64)

    def scatter(x: np.ndarray) -> np.ndarray:
        y = centred(x)
        return y.T @ y

    summed = _parts(fit, d, scatter, "double")
    cov = np.array([summed[i] for i in range(d)]) / n
    values, axes = jacobi((cov + cov.T) / 2)
    k = min(components, d)
    varies = values[:k] > d * np.finfo(np.float64).eps * max(values[0], 0.0)
    live = int(varies.sum())
    turn = axes[:, :live] / np.sqrt(values[:live])
    trace = float(values.sum())
    explained = [float(max(e, 0.0)) / trace if ok else 0.0 for e, ok in zip(values[:k], varies, strict=True)]

    def moments(x: np.ndarray) -> list[np.ndarray]:
        y = centred(x) @ turn
        return [y.sum(axis=0), *(y.T @ y)]

    error = None
    if live:
        met = _parts(fit, d, moments, "double")
        mean = met[0] / n
        error = float(np.abs(np.array([met[i + 1] for i in range(live)]) / n - np.outer(mean, mean) - np.eye(live)).max())

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            t = exact_offsets(_matrix(b.column(1), d), n, sums)
            y = (t / n).astype(np.float64) @ turn
            size = b.num_rows
            padded = [[*row, *[None] * (k - live)] for row in y.tolist()]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array([n] * size, pa.int64()), pa.array(squares(t), pa.int64()), pa.array(padded, pa.list_(pa.float64())), pa.array([explained] * size, pa.list_(pa.float64())), pa.array([error] * size, pa.float64())],
                ["id", "n", "deviation", "whitened", "explained", "identity_error"],
            )

    return rows.mapInArrow(project, kind)
