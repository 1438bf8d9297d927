"""Whitening of embeddings by shifted CholeskyQR.

Entries are taken as integers ``x = floor(1024 * c) + 100000``. Sums of x are exact, and every pass centres a row before
it multiplies: with the sum S = q * n + r, ``(x - q) - r / n``. A pass is one distributed job: each task turns its rows
into ``Q = A / (R1 R2 ...)`` by triangular solves with the factors so far and adds up its ``Q'Q``; the tasks' sums are added
row by row of the matrix on the executors, so the driver receives one d x d matrix, whatever the number of rows or
tasks. The driver factors it by Cholesky, in the first pass with a shift that keeps it positive definite however ill
conditioned A is, and the passes go on until Q'Q is a projection to rounding (the identity at full rank). The
last Q'Q counts as a factor too (its square root, where directions without variance make it singular). R, the product
of all factors, has A's singular values and right singular vectors: an SVD of it gives components and eigenvalues
without ever squaring the condition number.

Defined cases: rows whose vector is null or holds null or non-finite entries, or entries of 2**36 and more, or that is
not of the most frequent length, are dropped; zero vectors, repeated rows and rows without vec_id take part as they are. A
component whose standard deviation is below ``LEAST`` of the first's is none (one row, or equal rows, have none, and give
no rows). ``deviation`` is null where it exceeds a long. An empty table gives an empty one. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marquee.llm.common import written
from marquee.llm.vectors import common_size

SCALE, SHIFT = 1024, 100_000
#: Entries from here on are no usable ones: products of x stay exact below.
LARGEST = float(1 << 36)
#: Rounds end when Q'Q is a projection to this, or after ``ROUNDS``.
EXACT, ROUNDS = 1e-12, 8
LEAST = 1e-11
OUT = ("vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double")


def integers(rows: DataFrame) -> DataFrame:
    """``vec_id, x``: the remaining rows with their vectors as integers, of one length."""
    vector = F.col("vector").cast("array<double>")
    some = rows.select(F.col("vec_id").cast("long").alias("vec_id"), vector.alias("vector")).where(
        F.col("vector").isNotNull() & (F.size("vector") > 0)
        & ~F.exists("vector", lambda c: c.isNull() | F.isnan(c) | (F.abs(c) >= LARGEST)))
    d = common_size(some)
    x = F.transform("vector", lambda c: F.floor(c * SCALE).cast("long") + SHIFT)
    return written(some.where(F.size("vector") == d).select("vec_id", x.alias("x")), "integers")


def _matrix(column: pa.Array, d: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), d)


def sums(rows: DataFrame, d: int) -> tuple[int, list[int]]:
    """The number of rows and the exact sum of each dimension."""
    def add(batches):
        for b in batches:
            if b.num_rows:
                s = _matrix(b.column(0), d).sum(0)
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(-1, d, dtype=np.int32)), pa.array(np.append(b.num_rows, s))],
                                                 names=["i", "s"])

    found = (rows.select("x").mapInArrow(add, "i int, s long").groupBy("i")
             .agg(F.sum(F.col("s").cast("decimal(20,0)")).alias("s")).collect())  # one row per dimension
    total = {r["i"]: int(r["s"]) for r in found}
    return total.get(-1, 0), [total.get(i, 0) for i in range(d)]


def centred(n: int, s: list[int]) -> Callable[[np.ndarray], np.ndarray]:
    whole = np.array([v // n for v in s], np.int64)
    rest = np.array([v % n / n for v in s])
    return lambda x: (x - whole) - rest


def solved(a: np.ndarray, r: np.ndarray) -> np.ndarray:
    """``a`` times the inverse of the upper triangle ``r``, column by column."""
    q = np.empty_like(a)
    for j in range(a.shape[1]):
        q[:, j] = (a[:, j] - q[:, :j] @ r[:j, j]) / r[j, j]
    return q


def summed(rows: DataFrame, d: int, shape: tuple[int, int], each: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """The sum over all rows of matrices: ``each`` gives that of a block of x-vectors."""
    def local(batches):
        total = np.zeros(shape)
        for b in batches:
            if b.num_rows:
                total += each(_matrix(b.column(0), d))
        yield table(range(shape[0]), total)

    def add(batches):
        total: dict[int, np.ndarray] = {}
        for b in batches:
            values = _matrix(b.column(1), shape[1])
            for i, v in zip(b.column(0).to_pylist(), values, strict=True):
                total[i] = total[i] + v if i in total else v.copy()
        yield table(total, np.array(list(total.values())).reshape(-1, shape[1]))

    def table(which, values):
        ends = np.arange(len(values) + 1, dtype=np.int32) * shape[1]
        return pa.RecordBatch.from_arrays([pa.array(list(which), pa.int32()), pa.ListArray.from_arrays(ends, pa.array(values.ravel()))],
                                          names=["i", "v"])

    parts = min(shape[0], int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    found = (rows.select("x").mapInArrow(local, "i int, v array<double>").repartition(parts, "i")
             .mapInArrow(add, "i int, v array<double>").collect())  # one row per row of the matrix
    out = np.zeros(shape)
    for r in found:
        out[r["i"]] = r["v"]
    return out


def root(gram: np.ndarray) -> np.ndarray:
    """A factor F with F'F = gram, which may be singular."""
    value, vector = np.linalg.eigh(gram)
    return np.sqrt(np.maximum(value, 0))[:, None] * vector.T


def triangle(rows: DataFrame, d: int, n: int, s: list[int], rounds: int = ROUNDS) -> tuple[np.ndarray, float, int]:
    """R of the centred rows (R'R is their Gram matrix), the Gram matrix's trace, and the passes made."""
    centre, factors, trace, passes = centred(n, s), [], 0.0, 0
    while True:
        def gram(x, factors=tuple(factors)):
            q = centre(x)
            for f in factors:
                q = solved(q, f)
            return q.T @ q

        g = summed(rows, d, (d, d), gram)
        passes += 1
        trace = trace if factors else float(np.trace(g))
        if not trace:
            return np.zeros((d, d)), 0.0, passes
        if factors and np.abs(g @ g - g).max() <= EXACT or passes == rounds:
            break
        shift = 11 * (n * d + d * (d + 1)) * np.finfo(float).eps / 2 * np.linalg.eigvalsh(g)[-1]
        try:
            factors.append(np.linalg.cholesky(g + (0 if factors else shift) * np.eye(d)).T)
        except np.linalg.LinAlgError:  # directions without variance
            factors.append(np.linalg.cholesky(g + shift * np.eye(d)).T)
    r = root(g)
    for f in reversed(factors):
        r = r @ f
    return r, trace, passes


def whitened(rows: DataFrame, most: int = 8) -> DataFrame:
    """``vec_id, component, n, deviation, whitened, explained, identity_error``: a row per remaining row of
    ``rows(vec_id, vector)`` and component."""
    spark = rows.sparkSession
    table = integers(rows)
    head = table.first()
    if head is None:
        return spark.createDataFrame([], OUT)
    d = len(head["x"])
    n, s = sums(table, d)
    r, trace, _ = triangle(table, d, n, s)
    sigma, v = np.linalg.svd(r)[1:]
    keep = np.flatnonzero(sigma > LEAST * max(sigma[0], np.finfo(float).tiny))[:most]
    if not len(keep):
        return spark.createDataFrame([], OUT)
    v = v[keep].T
    v = v * np.where(v[np.abs(v).argmax(0), np.arange(len(keep))] < 0, -1.0, 1.0)
    e = sigma[keep] ** 2 / n
    project, centre, k = v / np.sqrt(e), centred(n, s), len(keep)

    def of(x):
        return centre(x) @ project

    mean = summed(table, d, (1, k), lambda x: of(x).sum(0, keepdims=True))[0] / n

    def products(x):
        w = of(x) - mean
        return w.T @ w

    error = float(np.abs(summed(table, d, (k, k), products) / n - np.eye(k)).max())
    explained = e / (trace / n)
    whole, rest = np.array([t // n for t in s], object), np.array([t % n for t in s], object)

    def deviations(x):
        far = x - whole.astype(np.int64)
        if d * (n * (int(np.abs(far).max()) + 1)) ** 2 < 1 << 63:
            return pa.array(((n * far - rest.astype(np.int64)) ** 2).sum(1))
        exact = ((n * far.astype(object) - rest) ** 2).sum(1)
        return pa.array([z if z < 1 << 63 else None for z in exact], pa.int64())

    def out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                x, m = _matrix(b.column("x"), d), b.num_rows * k
                at = pa.array(np.repeat(np.arange(b.num_rows), k))
                yield pa.RecordBatch.from_arrays(
                    [b.column("vec_id").take(at), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), b.num_rows)),
                     pa.array(np.full(m, n)), deviations(x).take(at), pa.array(of(x).ravel()),
                     pa.array(np.tile(explained, b.num_rows)), pa.array(np.full(m, error))],
                    names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return table.select("vec_id", "x").mapInArrow(out, OUT)
