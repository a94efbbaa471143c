"""Whitening of embeddings: an exact distributed covariance, its leading eigenvectors, a broadcast projection."""

from __future__ import annotations

from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postvet.llm.common import ready
from postvet.session import stored

SCALE, SHIFT = 1024, 100_000
WIDE = pa.decimal128(38, 0)
# Values up to this size are summed over a batch, and squared, in 64 bits.
SAFE = 1 << 24
# Rows of one returned Arrow batch.
BATCH_ROWS = 4096
EPS = np.finfo(float).eps


# --- eigenvectors of a symmetric matrix

def householder(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """(diagonal, off diagonal, reflectors) of the tridiagonal form of a symmetric matrix.

    Reflector k mirrors the entries after k onto their first one: H = I - 2 v v', v of
    length 1. Zero columns have none.
    """
    a = np.array(matrix, float)
    size = len(a)
    reflectors = []
    for k in range(size - 2):
        v = a[k + 1:, k].copy()
        length = np.linalg.norm(v)
        if length > 0:
            v[0] += np.copysign(length, v[0])
            v /= np.linalg.norm(v)
            rest = a[k + 1:, k + 1:]
            p = rest @ v
            w = 2 * (p - (v @ p) * v)
            rest -= np.outer(v, w) + np.outer(w, v)
            head = a[k + 1:, k] - 2 * v * (v @ a[k + 1:, k])
            a[k + 1:, k] = a[k, k + 1:] = head
        reflectors.append(v)
    return a.diagonal().copy(), a.diagonal(1).copy() if size > 1 else np.empty(0), reflectors


def sturm_counts(d: np.ndarray, e: np.ndarray, x: np.ndarray) -> np.ndarray:
    """How many eigenvalues of the tridiagonal (d, e) are below each x: negative pivots."""
    tiny = np.finfo(float).tiny / EPS * (1 + (e * e).max(initial=0.0))
    pivot = d[0] - x
    count = (pivot < 0).astype(int)
    for i in range(1, len(d)):
        pivot = np.where(np.abs(pivot) < tiny, -tiny, pivot)
        pivot = d[i] - x - e[i - 1] ** 2 / pivot
        count += pivot < 0
    return count


def leading_eigenvalues(d: np.ndarray, e: np.ndarray, count: int) -> np.ndarray:
    """The `count` largest eigenvalues, falling, by bisection down to neighbouring doubles."""
    size = len(d)
    radius = np.concatenate([[0], np.abs(e)]) + np.concatenate([np.abs(e), [0]])
    low, high = (d - radius).min(), (d + radius).max()
    slack = EPS * size * max(abs(low), abs(high)) + np.finfo(float).tiny
    lower, upper = np.full(count, low - slack), np.full(count, high + slack)
    # Of the eigenvalues in rising order, the wanted ones have these places.
    place = size - 1 - np.arange(count)
    while True:
        middle = lower + (upper - lower) / 2
        open_ = (middle > lower) & (middle < upper)
        if not open_.any():
            return middle
        above = sturm_counts(d, e, middle) > place
        upper = np.where(open_ & above, middle, upper)
        lower = np.where(open_ & ~above, middle, lower)


def _solve(d: np.ndarray, e: np.ndarray, shift: float, right: np.ndarray) -> np.ndarray:
    """Solution of (T - shift) x = right by elimination with row exchanges; tiny pivots are lifted."""
    size = len(d)
    # Rows of the upper factor: pivot, next, and the one after that exchanges fill in.
    u0, u1, u2 = d - shift, np.append(e, 0.0), np.zeros(size)
    b = right.copy()
    norm = max(np.abs(d).max(), np.abs(e).max(initial=0.0), abs(shift), np.finfo(float).tiny)
    for i in range(size - 1):
        below, diagonal, after = e[i], u0[i + 1], u1[i + 1]
        if abs(below) > abs(u0[i]):
            top = (u0[i], u1[i], u2[i])
            u0[i], u1[i], u2[i] = below, diagonal, after
            b[i], b[i + 1] = b[i + 1], b[i]
            factor = top[0] / below
            u0[i + 1], u1[i + 1] = top[1] - factor * diagonal, top[2] - factor * after
        else:
            if u0[i] == 0:
                u0[i] = EPS * norm
            factor = below / u0[i]
            u0[i + 1], u1[i + 1] = diagonal - factor * u1[i], after - factor * u2[i]
        b[i + 1] -= factor * b[i]
    x = np.zeros(size + 2)
    for i in range(size - 1, -1, -1):
        pivot = u0[i] if abs(u0[i]) > EPS * norm else np.copysign(EPS * norm, u0[i])
        x[i] = (b[i] - u1[i] * x[i + 1] - u2[i] * x[i + 2]) / pivot
        # Near an eigenvalue the solution grows without bound: keep it in range.
        if abs(x[i]) > 1e200:
            x /= 1e200
            b /= 1e200
    return x[:size]


def tridiagonal_vectors(d: np.ndarray, e: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Unit eigenvectors, as rows, for falling eigenvalues, by inverse iteration.

    Values nearer than a thousandth of the matrix's norm to the one before form a
    cluster, whose vectors are made orthogonal to each other after every step.
    """
    size = len(d)
    norm = max(np.abs(d).max(), np.abs(e).max(initial=0.0), np.finfo(float).tiny)
    draw = np.random.default_rng(12)
    found = np.zeros((len(values), size))
    start = 0
    for i, value in enumerate(values):
        if i and values[i - 1] - value > 1e-3 * norm:
            start = i
        # Equal values get shifts apart by some units in the last place.
        shift = value - (i - start) * 2 * EPS * norm
        cluster = found[start:i]
        x = draw.standard_normal(size)
        for _ in range(5):
            x = _solve(d, e, shift, x / np.linalg.norm(x))
            for _ in range(2):
                x -= cluster.T @ (cluster @ x)
            x /= np.linalg.norm(x)
        found[i] = x
    return found


def leading_eigen(matrix: np.ndarray, count: int) -> tuple[np.ndarray, np.ndarray]:
    """(values falling, unit vectors as rows) of the `count` largest eigenvalues of a symmetric matrix."""
    count = min(count, len(matrix))
    if not count:
        return np.empty(0), np.empty((0, len(matrix)))
    # To about 1 in size, so that nothing under- or overflows on the way.
    size = np.abs(matrix).max()
    if size == 0:
        return np.zeros(count), np.eye(count, len(matrix))
    d, e, reflectors = householder(matrix / size)
    values = leading_eigenvalues(d, e, count)
    vectors = tridiagonal_vectors(d, e, values)
    for k in range(len(reflectors) - 1, -1, -1):
        v = reflectors[k]
        if v.any():
            vectors[:, k + 1:] -= 2 * np.outer(vectors[:, k + 1:] @ v, v)
    return values * size, vectors


# --- integer moments

def _matrix(batch: pa.RecordBatch, column: int, size: int) -> np.ndarray:
    """The vectors of a batch as rows: int64, or Python integers where 64 bits might not do."""
    values = batch.column(column).flatten()
    flat = values.to_numpy(zero_copy_only=False)
    return flat.reshape(-1, size)


def _sums(rows: DataFrame, size: int) -> list[int]:
    """Exact sum of each dimension."""
    found = (
        rows.select(F.posexplode("x").alias("at", "x")).groupBy("at")
        .agg(F.sum(F.col("x").cast("decimal(38,0)")).alias("s")).collect()
    )
    made = [0] * size
    for r in found:
        made[r["at"]] = int(r["s"])
    return made


def centred_products(rows: DataFrame, centre: list[int]) -> list[list[int]]:
    """Sums over all rows of (x - centre)(x - centre)', exact, as Python integers.

    Each task adds up its rows and passes on the upper triangle once.
    """
    size = len(centre)
    upper = np.triu_indices(size)

    def run(batches):
        total = np.zeros(len(upper[0]), object)
        middle = np.array(centre, object)
        for batch in batches:
            x = _matrix(batch, 0, size)
            y = x.astype(object) - middle if max(map(abs, centre)) > 1 << 62 else x - middle.astype(np.int64)
            if y.dtype != object and len(y) and max(abs(int(y.max())), abs(int(y.min()))) > SAFE:
                y = y.astype(object)
            # Entries of at most 2^24 and batches of at most 2^15 rows keep sums in 64 bits.
            for i in range(0, len(y), 1 << 14):
                part = y[i:i + (1 << 14)]
                total = total + (part.T @ part)[upper].astype(object)
        yield pa.RecordBatch.from_arrays(
            [pa.array(range(len(total)), pa.int32()), pa.array([Decimal(int(t)) for t in total], WIDE)], ["cell", "v"]
        )

    found = (
        rows.select("x").mapInArrow(run, "cell int, v decimal(38,0)")
        .groupBy("cell").agg(F.sum("v").alias("v")).collect()
    )
    made = [[0] * size for _ in range(size)]
    for r in found:
        i, j = int(upper[0][r["cell"]]), int(upper[1][r["cell"]])
        made[i][j] = made[j][i] = int(r["v"])
    return made


def covariance(rows: DataFrame, n: int, sums: list[int]) -> np.ndarray:
    """Covariance with divisor n: vectors are centred at their rounded mean before they are multiplied.

    The products are whole numbers, so their sums are exact in any order; what rounding
    the mean leaves is taken off exactly too, and each entry is rounded once, at the end.
    """
    centre = [(2 * s + n) // (2 * n) for s in sums]
    rest = [s - n * c for s, c in zip(sums, centre)]
    products = centred_products(rows, centre)
    square = n * n
    return np.array([
        [(n * p - a * b) / square for p, b in zip(line, rest)] for line, a in zip(products, rest)
    ])


# --- the operator

def _usable(vectors: DataFrame, key: str, vector: str) -> DataFrame:
    """(key, x) of the rows whose vector has a finite number everywhere."""
    bad = F.exists(vector, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    rows = vectors.filter(F.col(vector).isNotNull() & ~bad & (F.size(vector) > 0))
    return rows.select(key, F.transform(vector, lambda c: F.floor(c.cast("double") * SCALE) + F.lit(SHIFT)).alias("x"))


def whiten(vectors: DataFrame, components: int = 8, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(key, component, n, deviation, whitened, explained, identity_error): a row per vector and component.

    An entry c counts as x = floor(1024 c) + 100000. The covariance of all x-vectors is
    exact up to the last rounding; its leading eigenvectors come from Householder
    tridiagonalisation, bisection by Sturm counts and inverse iteration on the driver,
    whose work and memory depend on the number of dimensions alone. Whitened is the
    centred vector on a unit eigenvector over the root of its eigenvalue.

    Rows whose vector is null, empty or holds null or non-finite entries are left out; so
    are vectors of another length than most have (of lengths equally frequent the longer
    one counts), and those with an entry of 2^62 or more after scaling, which long integers
    do not hold. Components
    without variance, beyond the rank of the covariance, have no rows, so a single vector
    gives none. Repeated rows and null keys count and are returned each. `deviation` is a
    decimal of 38 digits. An empty table gives no rows. Other columns are not looked at.
    """
    spark = ready(vectors.sparkSession)
    kind = vectors.schema[key].dataType.simpleString()
    schema = (
        f"`{key}` {kind}, component int, n long, deviation decimal(38,0), whitened double, "
        "explained double, identity_error double"
    )
    limit = float(1 << 62) / SCALE
    within = vectors.filter(~F.exists(vector, lambda c: F.abs(c.cast("double")) >= limit) | F.col(vector).isNull())
    rows = stored(_usable(within, key, vector))
    lengths = rows.groupBy(F.size("x").alias("size")).count().orderBy(F.desc("count"), F.desc("size")).first()
    if lengths is None:
        return spark.createDataFrame([], schema)
    size, n = lengths["size"], lengths["count"]
    rows = rows.filter(F.size("x") == size)
    sums = _sums(rows, size)
    matrix = covariance(rows, n, sums)
    trace = float(np.trace(matrix))
    values, axes = leading_eigen(matrix, components)
    kept = values > trace * size * EPS
    values, axes = values[kept], axes[kept]
    if not len(values):
        return spark.createDataFrame([], schema)
    shared = spark.sparkContext.broadcast((n, sums, axes / np.sqrt(values)[:, None]))

    def projected(batch, column):
        """n x - S, exactly, and the whitened components."""
        n, sums, axes = shared.value
        x = _matrix(batch, column, len(sums))
        wide = max(abs(int(x.max())), abs(int(x.min())), 1) * n + max(map(abs, sums)) >= 1 << 62 if len(x) else False
        off = (x.astype(object) if wide else x) * n - np.array(sums, object if wide else np.int64)
        return off, (off / n).astype(float) @ axes.T

    def means(batches):
        total = np.zeros(len(values))
        for batch in batches:
            total += projected(batch, 0)[1].sum(0)
        yield pa.RecordBatch.from_arrays([pa.array(range(len(total)), pa.int32()), pa.array(total)], ["cell", "v"])

    def added(run, cells: int) -> np.ndarray:
        made = np.zeros(cells)
        for r in rows.select("x").mapInArrow(run, "cell int, v double").groupBy("cell").agg(F.sum("v").alias("v")).collect():
            made[r["cell"]] = r["v"]
        return made

    mean = added(means, len(values)) / n

    def squares(batches):
        total = np.zeros((len(values), len(values)))
        for batch in batches:
            off = projected(batch, 0)[1] - mean
            total += off.T @ off
        flat = total.ravel()
        yield pa.RecordBatch.from_arrays([pa.array(range(len(flat)), pa.int32()), pa.array(flat)], ["cell", "v"])

    spread = added(squares, len(values) ** 2).reshape(len(values), -1) / n
    error = float(np.abs(spread - np.eye(len(values))).max())
    explained = values / trace

    def give(batches):
        for whole in batches:
            for start in range(0, whole.num_rows, BATCH_ROWS):
                batch = whole.slice(start, BATCH_ROWS)
                off, white = projected(batch, 1)
                top = max(abs(int(off.max())), abs(int(off.min())))
                squared = off * off if top * top * off.shape[1] < 1 << 63 else off.astype(object) ** 2
                deviation = pa.array([Decimal(int(v)) for v in squared.sum(1)], WIDE)
                at = pa.array(np.repeat(np.arange(batch.num_rows), len(explained)))
                count = batch.num_rows * len(explained)
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).take(at), pa.array(np.tile(np.arange(1, len(explained) + 1), batch.num_rows), pa.int32()),
                    pa.array(np.full(count, n)), deviation.take(at), pa.array(white.ravel()),
                    pa.array(np.tile(explained, batch.num_rows)), pa.array(np.full(count, error)),
                ], [f.split()[0].strip("`") for f in schema.split(", ")])

    return rows.select(key, "x").mapInArrow(give, schema)
