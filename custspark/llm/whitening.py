"""Embedding whitening by QDWH spectral divide-and-conquer (operator 12).

Every entry ``c`` of a usable vector becomes the whole number
``x = floor(64 * c) + 1000000``.  Two passes over the vectors, one row a task each, give the
number of vectors, the sums and the covariance ``V``: entries are centred at the rounded mean
before they are multiplied, products are exact whole numbers, and the rest of the
centring is done exactly at the end.

``V`` is d x d, so its size is bounded by the dimension, not by the rows, and its eigenvectors
are found on the driver: the polar factor ``U`` of ``V - s I`` (QDWH: dynamically weighted
Halley steps by QR) tells the eigenvalues above the shift from those below, since
``(U + I) / 2`` projects on the former.  Orthonormal bases of both subspaces split ``V``
in two, and each half is split again.  The whitening matrix (at most d x ``components``)
travels to all tasks; one pass sums up the covariance of the whitened vectors, one
returns them.

Left out, as they take no part: vectors that are null, empty, or hold null or non-finite
entries; and vectors of another length than most (the longer if two lengths are equally
frequent).  Rows with equal ids are rows of their own; other columns are not looked at.
Directions without variance (eigenvalue at rounding level) are no components,
so one vector, equal vectors or an empty table give no rows.  ``deviation`` is null where it
does not fit a long.  Whole numbers are exact up to 2**62 for sums of products (entries of a size of 2**50 at most);
beyond that sums are taken in doubles.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_arrow, materialize

SCALE = 64
OFFSET = 1_000_000
COMPONENTS = 32
_ROWS = 2048


# --- the d x d part --------------------------------------------------------------

def polar_factor(a: np.ndarray) -> np.ndarray:
    """Orthogonal polar factor of a symmetric matrix by QDWH."""
    n = len(a)
    eye = np.eye(n)
    top = np.linalg.norm(a, 2) * (1 + 1e-12)
    x = a / top
    low = min(max(1.0 / (np.linalg.cond(x, 1) * math.sqrt(n)) if n > 1 else 1.0, 1e-16), 1.0)
    for _ in range(30):
        t = np.cbrt(4.0 * (1.0 - low * low) / low ** 4)
        root = math.sqrt(1.0 + t)
        wa = root + 0.5 * math.sqrt(max(8.0 - 4.0 * t + 8.0 * (2.0 - low * low) / (low * low * root), 0.0))
        wb = (wa - 1.0) ** 2 / 4.0
        wc = wa + wb - 1.0
        q = np.linalg.qr(np.vstack([math.sqrt(wc) * x, eye]))[0]
        new = (wb / wc) * x + (wa - wb / wc) / math.sqrt(wc) * (q[:n] @ q[n:].T)
        new = (new + new.T) / 2.0
        low = min(low * (wa + wb * low * low) / (1.0 + wc * low * low), 1.0)
        step = np.linalg.norm(new - x)
        x = new
        if step <= 1e-13 * math.sqrt(n) and 1.0 - low < 1e-10:
            break
    return x


def _split(a: np.ndarray, basis: np.ndarray, out: list[tuple[float, np.ndarray]], size: float) -> None:
    """Put ``(eigenvalue, eigenvector)`` of ``a``, seen in ``basis``, into ``out``."""
    n = len(a)
    middle = np.trace(a) / n
    if n == 1 or np.linalg.norm(a - middle * np.eye(n)) <= 4e-15 * size:
        out += [(float(a[i, i]), basis[:, i]) for i in range(n)]
        return
    # a shift between the extreme diagonal entries lies between the extreme eigenvalues
    diagonal = np.sort(np.diag(a))
    shifts = [float(np.median(diagonal)), middle, *(diagonal[1:] + diagonal[:-1])[np.argsort(-np.diff(diagonal))] / 2.0]
    for shift in shifts:
        away = 1e-14 * size
        projector = (polar_factor(a - (shift + away) * np.eye(n)) + np.eye(n)) / 2.0
        rank = float(np.trace(projector))
        k = round(rank)
        if 0 < k < n and abs(rank - k) < 1e-6 and np.linalg.norm(projector @ projector - projector) < 1e-8:
            break
    else:  # two-by-two rotations never fail to split
        k, projector = _rotation(a)
    columns = np.argsort(-np.diag(projector), kind="stable")[:k]
    first = np.linalg.qr(projector @ np.eye(n)[:, columns])[0]
    full = np.linalg.qr(np.hstack([projector @ first, np.eye(n)]))[0]  # completes the basis
    for part in (full[:, :k], full[:, k:]):
        _split(_symmetric(part.T @ a @ part), basis @ part, out, size)


def _rotation(a: np.ndarray) -> tuple[int, np.ndarray]:
    """The subspace of the largest eigenvalue by subspace iteration: for matrices that no tried shift splits."""
    v = np.ones((len(a), 1)) / math.sqrt(len(a))
    moved = a + np.linalg.norm(a) * np.eye(len(a))
    for _ in range(10_000):
        w = moved @ v
        w /= np.linalg.norm(w)
        if np.linalg.norm(w - v) < 1e-15:
            break
        v = w
    return 1, v @ v.T


def _symmetric(a: np.ndarray) -> np.ndarray:
    return (a + a.T) / 2.0


def spectrum(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, falling, and unit eigenvectors (columns) of a symmetric matrix."""
    out: list[tuple[float, np.ndarray]] = []
    size = float(np.linalg.norm(v))
    if len(v):
        _split(_symmetric(v), np.eye(len(v)), out, size)
    out.sort(key=lambda p: -p[0])
    vectors = np.stack([x for _, x in out], axis=1) if out else np.zeros((0, 0))
    return _refine(v, vectors)


def _refine(v: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One step that squares the error of a full set of nearly right eigenvectors (first-order
    correction of every pair whose eigenvalues differ)."""
    if not len(v):
        return np.zeros(0), x
    for _ in range(2):
        r = np.eye(len(v)) - x.T @ x
        s = x.T @ v @ x
        e = np.diag(s) / (1.0 - np.diag(r))
        gap = e[None, :] - e[:, None]
        close = np.abs(gap) <= 1e-10 * np.abs(e).max()
        fix = np.where(close, r / 2.0, (s + e[None, :] * r) / np.where(close, 1.0, gap))
        x = x + x @ fix
    order = np.argsort(-e, kind="stable")
    x = x[:, order] / np.linalg.norm(x[:, order], axis=0)
    return e[order], x


# --- the passes over the rows ------------------------------------------------------

def usable(vectors: DataFrame, id_col: str, vector_col: str) -> tuple[DataFrame, int]:
    """``(vec_id, vector)`` of the vectors that take part, and their length."""
    vector = F.col(vector_col).cast("array<double>")
    good = (F.size(vector) > 0) & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), vector.alias("vector")).where(F.coalesce(good, F.lit(False)))
    lengths = rows.groupBy(F.size("vector").alias("d")).agg(F.count(F.lit(1)).alias("n"))
    dim = lengths.agg(F.max_by("d", F.struct("n", "d"))).first()[0]
    return rows.where(F.size("vector") == F.lit(dim or 0)), dim or 0


def _steps(batches: Iterator[pa.RecordBatch], dim: int, column: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Slices of the batches with their ``x`` as whole numbers."""
    for b in batches:
        for at in range(0, b.num_rows, _ROWS):
            part = b.slice(at, _ROWS)
            flat = part.column(column).flatten().to_numpy(zero_copy_only=False)
            yield part, np.floor(SCALE * flat.reshape(-1, dim)).astype(np.int64) + OFFSET


def sums(rows: DataFrame, dim: int) -> tuple[int, list[int], list[int], list[int]]:
    """``(n, sums, least, greatest)`` of ``x`` by dimension, exact."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total, low, high = 0, [0] * dim, np.full(dim, np.iinfo(np.int64).max), np.full(dim, np.iinfo(np.int64).min)
        for _, x in _steps(batches, dim, 0):
            n += len(x)
            # in two halves, so that no sum of a step leaves 64 bits
            total = [t + (h << 20) + s for t, h, s in zip(total, (x >> 20).sum(axis=0).tolist(), (x & 0xFFFFF).sum(axis=0).tolist())]
            low, high = np.minimum(low, x.min(axis=0)), np.maximum(high, x.max(axis=0))
        if n:
            yield pa.RecordBatch.from_pydict({"n": np.full(dim, n), "dim": np.arange(dim, dtype=np.int32), "s": [str(t) for t in total],
                                              "low": low, "high": high})

    parts = map_arrow(rows.select("vector"), run, "n long, dim int, s string, low long, high long")
    got = (parts.groupBy("dim").agg(F.sum("n").alias("n"), F.sum(F.col("s").cast("decimal(38,0)")).alias("s"), F.min("low").alias("low"), F.max("high").alias("high"))
           .orderBy("dim").collect())  # one row a dimension
    return (got[0]["n"] if got else 0), [int(r["s"]) for r in got], [r["low"] for r in got], [r["high"] for r in got]


def _gram(rows: DataFrame, width: int, values, exact: bool) -> tuple[list[list], list]:
    """``(sum of y y', sum of y)`` over ``values(batches)``, blocks of rows ``y``: a row of sums a task and line, added up by Spark."""
    kind = "long" if exact else "double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gram = np.zeros((width + 1, width), np.int64 if exact else np.float64)
        seen = False
        for y in values(batches):
            seen = True
            y = y.astype(np.float64)
            # doubles hold sums of whole products up to 2**53
            step = max(1, int(2.0 ** 53 / max(1.0, float(np.abs(y).max()) ** 2))) if exact else len(y)
            for at in range(0, len(y), step):
                part = y[at:at + step]
                for line, add in ((slice(0, width), part.T @ part), (width, part.sum(axis=0))):
                    gram[line] += add.astype(gram.dtype)
        if seen:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(width + 1, dtype=np.int32)), pa.array(list(gram))], ["line", "v"])

    parts = map_arrow(rows.select("vector"), run, f"line int, v array<{kind}>")
    got = (parts.select("line", F.posexplode("v").alias("at", "x")).groupBy("line", "at").agg(F.sum("x").alias("x"))
           .groupBy("line").agg(F.transform(F.sort_array(F.collect_list(F.struct("at", "x"))), lambda p: p["x"]).alias("v"))
           .orderBy("line").collect())  # width + 1 rows
    return [r["v"] for r in got[:width]], (got[width]["v"] if got else [])


def covariance(rows: DataFrame, dim: int, n: int, total: list[int], low: list[int], high: list[int]) -> np.ndarray:
    """Covariance of ``x`` (divisor n), centred before multiplying; exact up to the last rounding."""
    centre = np.array([round(s / n) for s in total], np.int64)
    bound = max(max(h - int(c), int(c) - lo) for lo, h, c in zip(low, high, centre))
    exact = bound * bound * n < 1 << 62
    gram, rest = _gram(rows, dim, lambda batches: (x - centre for _, x in _steps(batches, dim, 0)), exact)
    if not exact:
        gram, rest = np.array(gram), np.array(rest)
        return _symmetric(gram / n - np.outer(rest / n, rest / n))
    out = np.zeros((dim, dim))
    for i in range(dim):
        for j in range(dim):
            out[i, j] = (n * gram[i][j] - rest[i] * rest[j]) / (n * n)  # whole numbers of any size, one rounding
    return out


def whiten(vectors: DataFrame, components: int = COMPONENTS, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``(vec_id, component, n, deviation, whitened, explained, identity_error)`` for each usable vector and component."""
    schema = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    rows, dim = usable(vectors, id_col, vector_col)
    if not dim:
        return vectors.sparkSession.createDataFrame([], schema)
    rows = materialize(rows, "vectors")
    n, total, low, high = sums(rows, dim)
    v = covariance(rows, dim, n, total, low, high)
    e, x = spectrum(v)
    trace = float(np.trace(v))
    keep = [i for i in range(min(components, dim)) if e[i] > max(dim, 2) * 4e-15 * e[0] and e[i] > 0.0]
    if not keep:
        return vectors.sparkSession.createDataFrame([], schema)
    weight = x[:, keep] / np.sqrt(e[keep])
    explained = e[keep] / trace
    centre = np.array([s // n for s in total], np.int64)
    rest = np.array([s - n * (s // n) for s in total], np.float64) / n  # the mean is centre + rest

    def whitened(x: np.ndarray) -> np.ndarray:
        return ((x - centre) - rest) @ weight

    k = len(keep)
    gram, mean = _gram(rows, k, lambda batches: (whitened(x) for _, x in _steps(batches, dim, 0)), False)
    gram, mean = np.array(gram) / n, np.array(mean) / n
    error = float(np.abs(gram - np.outer(mean, mean) - np.eye(k)).max())
    fits = all(n * (h - lo) < 1 << 62 for lo, h in zip(low, high))
    whole = np.array([n * int(c) - s for c, s in zip(centre, total)], np.int64) if n < 1 << 62 else None  # n * centre - S, less than n

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, x in _steps(batches, dim, 1):
            w = whitened(x)
            with np.errstate(over="ignore"):
                off = (x - centre) * n + whole
                deviation = (off * off).sum(axis=1)
                about = (off.astype(np.float64) ** 2).sum(axis=1)
            lost = (about >= 9.2e18) if fits else np.ones(len(x), bool)
            m = len(x)
            yield pa.RecordBatch.from_arrays([
                part.column(0).take(pa.array(np.repeat(np.arange(m), k))), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)),
                pa.array(np.full(m * k, n)), pa.array(np.repeat(deviation, k), mask=np.repeat(lost, k)), pa.array(w.reshape(-1)),
                pa.array(np.tile(explained, m)), pa.array(np.full(m * k, error))],
                ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return map_arrow(rows.select("vec_id", "vector"), run, schema)
