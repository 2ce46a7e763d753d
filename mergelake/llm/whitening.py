"""Embedding whitening: the leading components of the covariance by FEAST contour integration.

Spark makes the covariance exactly, in whole numbers, over the distinct vectors: their count and sums, then products of entries centred at the
rounded mean, from which the exact covariance follows.  What comes back has the square of the dimensions, whatever the number of rows.
FEAST then projects a random subspace onto the eigenvalues of an interval by a quadrature of shifted solves around it in the complex plane, Rayleigh-Ritz takes
the components from the subspace, and this is repeated until they settle.  Inertia (the signs of a symmetric factorisation's pivots) counts the eigenvalues above a shift:
it finds the intervals and verifies that no component of them is missed.

Edge cases: null vectors, empty ones, and those with null, non-finite or missing entries are dropped (``vectors.scaled``); values beyond 2**52 are held to it; repeated vectors
count once in the covariance and all come back; a component without variance can't be whitened and is left out, so one distinct vector alone gives no rows; a deviation beyond a long is null;
null and repeated ids are rows of their own; an empty table gives no rows.  Columns other than the id and the vector are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import stored
from .vectors import matrix, most, scaled

LIMIT = 1 << 52
NODES = 8
#: Rows whose products are summed in one go.
ROWS = 4096


def negatives(a: np.ndarray) -> int:
    """How many eigenvalues of a symmetric matrix are below 0: by Sylvester's law, those of the blocks of a pivoted factorisation."""
    a, count, ratio = a.copy(), 0, (1 + 17**0.5) / 8
    while len(a):
        diagonal = np.abs(np.diag(a))
        r = int(diagonal.argmax())
        off = np.abs(np.tril(a, -1))
        p, q = divmod(int(off.argmax()), len(a))
        if diagonal[r] >= ratio * off[p, q]:
            if not diagonal[r]:
                return count
            count += bool(a[r, r] < 0)
            block = [r]
        else:  # a block of two with a determinant below 0: one eigenvalue on each side
            count += 1
            block = [p, q]
        rest = np.setdiff1d(np.arange(len(a)), block)
        a = a[np.ix_(rest, rest)] - a[np.ix_(rest, block)] @ np.linalg.solve(a[np.ix_(block, block)], a[np.ix_(block, rest)])
        a = (a + a.T) / 2
    return count


def above(v: np.ndarray, shift: float) -> int:
    """How many eigenvalues are above a shift."""
    return negatives(shift * np.eye(len(v)) - v)


def intervals(v: np.ndarray, want: int, most_in_one: int = 4, steps: int = 80) -> list[tuple[float, float, int]]:
    """(low, high, eigenvalues in between), from above, that hold the ``want`` largest, all above 0, or as many as there are.

    An interval is wide by a factor of 8 at most, so that the quadrature sees its small eigenvalues as well as its large ones."""
    top = float(np.abs(v).sum(axis=1).max()) * 1.01
    least = top * len(v) * np.finfo(float).eps
    want = min(want, above(v, least))

    def split(low: float, high: float, n_low: int, n_high: int, steps: int) -> list[tuple[float, float, int]]:
        """n_low and n_high: eigenvalues above the ends."""
        if n_high >= want or n_low == n_high:
            return []
        if not steps or n_low - n_high <= most_in_one and n_low <= want + most_in_one and high <= 8 * low:
            return [(low, high, n_low - n_high)]
        mid = (low * high) ** 0.5 if high > 8 * low else (low + high) / 2
        n_mid = above(v, mid)
        return split(mid, high, n_mid, n_high, steps - 1) + split(low, mid, n_low, n_mid, steps - 1)

    return split(least, top, above(v, least), 0, steps) if want else []


def feast(v: np.ndarray, low: float, high: float, count: int, most_rounds: int = 60) -> tuple[np.ndarray, np.ndarray]:
    """The eigenvalues between low and high, of which there are ``count``, and their eigenvectors."""
    dims = len(v)
    width = min(dims, 2 * count + 8)
    q = np.random.RandomState(17).standard_normal((dims, width))
    at, weight = np.polynomial.legendre.leggauss(NODES)
    around = (high - low) / 2 * np.exp(1j * np.pi / 2 * (at + 1))
    best, stale = None, 0
    for _ in range(most_rounds):
        y = sum((w / 2 * r * np.linalg.solve((low + high) / 2 * np.eye(dims) + r * np.eye(dims) - v, q.astype(complex))).real for w, r in zip(weight, around, strict=True))
        basis, _ = np.linalg.qr(y)
        values, small = np.linalg.eigh(basis.T @ v @ basis)
        q = basis @ small
        inside = (values > low) & (values <= high)
        off = np.abs(v @ q[:, inside] - q[:, inside] * values[inside]).max() if inside.any() else np.inf
        if inside.sum() == count:
            if best is not None and off >= best[0] / 2:  # no closer than before: settled
                stale += 1
            if best is None or off < best[0]:
                best = (off, values[inside], q[:, inside])
            if stale >= 2 or off == 0:
                break
    if best is None or best[0] > 1e-9 * max(abs(high), abs(low)):
        raise ArithmeticError(f"{count} eigenvalues lie between {low} and {high}, and the subspace did not settle on them")
    return best[1], best[2]


def components(v: np.ndarray, want: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``want`` largest eigenvalues above 0, falling, and their unit eigenvectors as columns."""
    if not len(v) or not v.any():
        return np.zeros(0), np.zeros((len(v), 0))
    unit = float(np.abs(v).max())
    found = [feast(v / unit, *i) for i in intervals(v / unit, want)]
    if not found:
        return np.zeros(0), np.zeros((len(v), 0))
    # Once more over all intervals together, so that vectors of neighbouring ones are orthogonal.
    basis, _ = np.linalg.qr(np.concatenate([x for _, x in found], axis=1))
    values, small = np.linalg.eigh(basis.T @ v @ basis)
    return values[::-1][:want], (basis @ small)[:, ::-1][:, :want]


def product(x: np.ndarray) -> np.ndarray:
    """x.T @ x of whole numbers, exactly, as Python numbers."""
    if most(x) ** 2 * len(x) < 1 << 53:
        return (x.T.astype(float) @ x.astype(float)).astype(np.int64).astype(object)
    return x.T.astype(object) @ x.astype(object)


def totals(rows: DataFrame, dims: int, of: Callable[[np.ndarray], np.ndarray], kind: str) -> dict[tuple[int, int], object]:
    """The sum over all rows' vectors of a matrix made from some of them; a task returns one sum for each cell on or above the diagonal."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = 0
        for batch in batches:
            x = matrix(batch.column(0), dims)
            for k in range(0, len(x), ROWS):
                total = total + of(x[k : k + ROWS])
        if not np.isscalar(total):
            i, j = np.triu_indices(total.shape[0], 0, total.shape[1])
            cells = total[i, j].tolist()
            values = pa.array([str(c) for c in cells]) if kind == "string" else pa.array(cells, pa.float64())
            yield pa.RecordBatch.from_arrays([pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32)), values], ["i", "j", "value"])

    value = F.col("value").cast("decimal(38,0)") if kind == "string" else F.col("value")
    return {(r.i, r.j): r.total for r in rows.select("x").mapInArrow(add, f"i int, j int, value {kind}").groupBy("i", "j").agg(F.sum(value).alias("total")).collect()}


def covariance(fit: DataFrame, dims: int) -> tuple[int, list[int], np.ndarray]:
    """How many vectors there are, their sums, and their covariance: each entry exact until it is rounded."""
    ones = lambda x: np.concatenate([[len(x)], x.sum(axis=0, dtype=object)])[None]
    sums = totals(fit, dims, ones, "string")
    n, sums = int(sums[0, 0]), [int(sums[0, k + 1]) for k in range(dims)]
    centre = np.array([(2 * s + n) // (2 * n) for s in sums], np.int64)
    squares = totals(fit, dims, lambda x: product(x - centre), "string")
    rest = [s - n * int(c) for s, c in zip(sums, centre, strict=True)]
    v = np.zeros((dims, dims))
    for (i, j), total in squares.items():
        v[i, j] = v[j, i] = float(Fraction(n * int(total) - rest[i] * rest[j], n * n))
    return n, sums, v


def whiten(rows: DataFrame, want: int = 4, scale: float = 256.0, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """A row for each kept row and component: the id, component, n, deviation, whitened, explained, identity_error and eigenvalue."""
    kept, dims, _ = scaled(rows, scale, vector_col, LIMIT, id=id_col)
    kind = rows.schema[id_col].dataType.simpleString()
    schema = f"id {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double, eigenvalue double"
    if not dims:
        return rows.sparkSession.createDataFrame([], schema).withColumnRenamed("id", id_col)
    fit = stored(kept.select("x").distinct())
    n, sums, v = covariance(fit, dims)
    values, vectors = components(v, want)
    mean, shares = np.array([float(Fraction(s, n)) for s in sums]), values / np.trace(v) if len(values) else values
    turned = vectors / np.sqrt(values)
    white = lambda x: (x - mean) @ turned

    def moments(x: np.ndarray) -> np.ndarray:
        w = np.c_[np.ones(len(x)), white(x)]
        return w.T @ w

    off = 0.0
    if len(values):  # measured on the whitened vectors themselves
        m = totals(fit, dims, moments, "double")
        means = [m[0, k + 1] / n for k in range(len(values))]
        off = max(abs(m[i + 1, j + 1] / n - means[i] * means[j] - (i == j)) for i in range(len(values)) for j in range(i, len(values)))

    def turn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = len(values)
        for batch in batches:
            x = matrix(batch.column(1), dims)
            if (n * most(x) + max(map(abs, sums))) ** 2 * dims < 1 << 63:
                deviation = ((n * x - np.array(sums, np.int64)) ** 2).sum(axis=1).tolist()
            else:
                deviation = [d if d < 1 << 63 else None for d in ((n * x.astype(object) - np.array(sums, object)) ** 2).sum(axis=1)]
            which = np.repeat(np.arange(len(x)), k)
            columns = [
                batch.column(0).take(pa.array(which)), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(x))), pa.array(np.full(len(which), n, np.int64)), pa.array(deviation, pa.int64()).take(pa.array(which)),
                pa.array(white(x).ravel()), pa.array(np.tile(shares, len(x))), pa.array(np.full(len(which), off)), pa.array(np.tile(values, len(x))),
            ]
            yield pa.RecordBatch.from_arrays(columns, ["id", "component", "n", "deviation", "whitened", "explained", "identity_error", "eigenvalue"])

    return kept.select("id", "x").mapInArrow(turn, schema).withColumnRenamed("id", id_col)
