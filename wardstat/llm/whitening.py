"""Embedding whitening: pivoted Cholesky of the centred scatter, then one-sided Jacobi on its factor.

Tasks add up the sums and then the centred products of the distinct vectors; what leaves a task has
the size of the model (dimension squared) and is added on the executors. The driver factors that
one matrix: with P V P' = R' R, rotations that make the rows of the triangular factor R orthogonal
give V's eigenvalues as their squared norms and its components as the normalised rows, without ever
forming an iterated product of V.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardstat.llm.common import column, schema_of, written
from wardstat.operators.passes import matrix, summed_arrays
from wardstat.session import ship_code

#: Steps of a unit that :func:`quantised` keeps apart.
STEPS_PER_UNIT = 256
#: Rotations are done when no pair of rows is further from orthogonal than this part of their norms.
ORTHOGONAL = 1e-15
#: Sweeps over all pairs, far more than the handful that convergence needs.
SWEEPS = 60

# Sums are carried as two doubles of this many bits, each exact.
_LOW_BITS = 26


def pivoted_cholesky(scatter: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Upper factor R (rank x n) and pivots so that ``scatter[pivots][:, pivots] = R' R``.

    The largest remaining diagonal entry is the next pivot; what is left below rounding ends it, so
    R has as many rows as ``scatter`` has rank.
    """
    rest = scatter.astype(float)
    n = len(rest)
    pivots = np.arange(n)
    factor = np.zeros((n, n))
    floor = n * np.finfo(float).eps * max(rest.diagonal().max(initial=0.0), 0.0)
    for k in range(n):
        best = k + int(np.argmax(rest.diagonal()[k:]))
        if rest[best, best] <= floor:
            return factor[:k], pivots
        if best != k:
            rest[[k, best]] = rest[[best, k]]
            rest[:, [k, best]] = rest[:, [best, k]]
            factor[:, [k, best]] = factor[:, [best, k]]
            pivots[[k, best]] = pivots[[best, k]]
        factor[k, k:] = rest[k, k:] / np.sqrt(rest[k, k])
        rest[k + 1 :, k + 1 :] -= np.outer(factor[k, k + 1 :], factor[k, k + 1 :])
    return factor, pivots


def _pairings(n: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Rounds of disjoint pairs in which every two of ``n`` numbers meet once."""
    players = list(range(n + n % 2))
    rounds = []
    for _ in range(len(players) - 1):
        pairs = [(a, b) for a, b in zip(players[: len(players) // 2], reversed(players)) if a < n and b < n]
        if pairs:
            rounds.append(tuple(np.array(side) for side in zip(*pairs)))
        players = [players[0], players[-1], *players[1:-1]]
    return rounds


def one_sided_jacobi(factor: np.ndarray) -> np.ndarray:
    """The columns of the factor's transpose rotated in pairs until all are orthogonal, as rows."""
    rows = factor.copy()
    rounds = _pairings(len(rows))
    for _ in range(SWEEPS):
        worst = 0.0
        for left, right in rounds:
            a, b = rows[left], rows[right]
            aa, bb, ab = (np.einsum("ij,ij->i", x, y) for x, y in ((a, a), (b, b), (a, b)))
            scale = np.sqrt(aa * bb)
            off = np.abs(ab) / np.where(scale > 0, scale, 1.0)
            worst = max(worst, float(off.max(initial=0.0)))
            turn = off > ORTHOGONAL
            ratio = (bb - aa) / np.where(turn, 2.0 * ab, 1.0)
            tangent = np.where(ratio >= 0, 1.0, -1.0) / (np.abs(ratio) + np.hypot(1.0, ratio))
            tangent = np.where(turn, tangent, 0.0)
            cosine = 1.0 / np.hypot(1.0, tangent)
            sine = (cosine * tangent)[:, None]
            rows[left], rows[right] = cosine[:, None] * a - sine * b, sine * a + cosine[:, None] * b
        if worst <= ORTHOGONAL:
            break
    return rows


def principal_components(covariance: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues above rounding, falling, and their unit eigenvectors as rows."""
    factor, pivots = pivoted_cholesky(covariance)
    rotated = one_sided_jacobi(factor)
    norms = np.linalg.norm(rotated, axis=1)
    order = np.argsort(-norms, kind="stable")
    components = np.zeros((len(order), len(covariance)))
    components[:, pivots] = rotated[order] / norms[order][:, None]
    return norms[order] ** 2, components


@dataclass(frozen=True)
class Whitening:
    """What :func:`fit` found; ``sums`` are exact whole numbers, components are rows."""

    n: int
    sums: tuple[int, ...]
    eigenvalues: np.ndarray
    components: np.ndarray
    trace: float
    identity_error: float

    @property
    def mean(self) -> np.ndarray:
        return np.array([s / self.n for s in self.sums]) if self.n else np.empty(0)


def finite(vector: Column) -> Column:
    """Whether a vector is there and all its entries are finite numbers."""
    limit = F.lit(float(np.finfo(np.float64).max))
    entry = lambda c: c.isNotNull() & (F.abs(c.cast("double")) <= limit)  # noqa: E731  NaN is above every number
    return F.coalesce(F.forall(vector, entry), F.lit(False))


def quantised(vectors: DataFrame, vector_col: str = "embedding", out: str = "x") -> DataFrame:
    """Rows with a finite vector, and ``out``: its entries times 256, rounded down to long.

    Null vectors and those with a null, NaN or infinite entry go. Entries beyond the range of long
    become its ends. Where vectors differ in length, those of the most frequent length stay (of equally
    frequent ones the longest), for only they can share a covariance; empty vectors have none and go.
    """
    vector = F.col(f"`{vector_col}`")
    usable = vectors.where(finite(vector) & (F.size(vector) > 0))
    lengths = usable.groupBy(F.size(vector).alias("size")).agg(F.count(F.lit(1)).alias("n"))
    common = lengths.orderBy(F.desc("n"), F.desc("size")).first()
    if common is not None:
        usable = usable.where(F.size(vector) == common["size"])
    steps = F.transform(vector, lambda c: F.floor(c.cast("double") * STEPS_PER_UNIT))
    return usable.withColumn(out, steps)


def fit(rows: DataFrame, vector_col: str = "x", components: int = 4) -> Whitening:
    """Components of the distinct vectors of ``rows`` (arrays of long, equally long, without nulls).

    Each distinct vector counts once, however many rows repeat it: repeats collapse on the map side, so
    a vector that a third of the rows share costs each task one row. Only sums of the size of the
    model reach the driver: n and the sums exactly, then the centred products, then the covariance of
    the whitened vectors. Constant dimensions and linear dependence lower the number of components; a
    table without rows, or with one distinct vector, has none.
    """
    distinct = written(rows.select(F.col(f"`{vector_col}`").alias("x")).distinct(), "whitening-fit")

    def totals(batch: pa.RecordBatch) -> dict[int, np.ndarray]:
        x = matrix(batch, "x")
        # Python's whole numbers, so that no sum of a batch can overflow.
        sums = x.sum(axis=0, dtype=object) if np.abs(x).max(initial=0) > (1 << 40) else x.sum(axis=0)
        high = [int(s) >> _LOW_BITS for s in sums]
        low = [int(s) & ((1 << _LOW_BITS) - 1) for s in sums]
        return {0: np.array([float(len(x)), *map(float, high), *map(float, low)])}

    found = summed_arrays(distinct, 0, totals)
    if not found:
        return Whitening(0, (), np.empty(0), np.empty((0, 0)), 0.0, 0.0)
    n, d = int(found[0][0]), (len(found[0]) - 1) // 2
    sums = tuple((int(h) << _LOW_BITS) + int(lo) for h, lo in zip(found[0][1 : 1 + d], found[0][1 + d :]))
    mean = np.array([s / n for s in sums])

    def products(batch: pa.RecordBatch) -> dict[int, np.ndarray]:
        centred = matrix(batch, "x") - mean
        return {0: centred.T @ centred}

    covariance = summed_arrays(distinct, 0, products)[0].reshape(d, d) / n
    values, vectors = principal_components(covariance)
    values, vectors = values[:components], vectors[:components]
    scaled = vectors / np.sqrt(values)[:, None]

    def whitened(batch: pa.RecordBatch) -> np.ndarray:
        return (matrix(batch, "x") - mean) @ scaled.T

    error = 0.0
    if len(values):
        centre = summed_arrays(distinct, 0, lambda batch: {0: whitened(batch).sum(axis=0)})[0] / n

        def spread(batch: pa.RecordBatch) -> dict[int, np.ndarray]:
            z = whitened(batch) - centre
            return {0: z.T @ z}

        found = summed_arrays(distinct, 0, spread)[0].reshape(len(values), len(values)) / n
        error = float(np.abs(found - np.eye(len(values))).max())
    return Whitening(n, sums, values, vectors, float(np.trace(covariance)), error)


def exact_deviation(x: np.ndarray, n: int, sums: tuple[int, ...]) -> list[int | None]:
    """For each row the sum of (n x - S)^2 in whole numbers; null where a long cannot hold it."""
    limit = (1 << 63) - 1
    reach = n * int(np.abs(x).max(initial=0)) + max((abs(s) for s in sums), default=0)
    if len(sums) * reach * reach <= limit:
        y = n * x - np.array(sums, np.int64)
        return (y * y).sum(axis=1).tolist()
    exact = [sum((n * int(v) - s) ** 2 for v, s in zip(row, sums)) for row in x]
    return [value if value <= limit else None for value in exact]


def whiten(rows: DataFrame, model: Whitening, vector_col: str = "x") -> DataFrame:
    """Each row of ``rows`` once per component, on the whitened axes of ``model``.

    Returns struct ``row`` (the row's columns but the vector, under their own names), ``component``
    (from 1), ``n``, ``deviation`` (the exact sum of (n x - S)^2, null where it exceeds a long), ``whitened``,
    ``explained`` and ``identity_error``. Repeated rows are repeated; a model without components gives
    no rows, as does an empty table.
    """
    ship_code(rows.sparkSession)
    others = [c for c in rows.columns if c != vector_col]
    packed = rows.select(F.struct(*[F.col(f"`{c}`") for c in others]).alias("row"), F.col(f"`{vector_col}`").alias("x"))
    k = len(model.eigenvalues)
    scaled = model.components / np.sqrt(model.eigenvalues)[:, None] if k else model.components
    explained = model.eigenvalues / model.trace if k else model.eigenvalues

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not k or not batch.num_rows:
                continue
            x = matrix(batch, "x")
            place = np.repeat(np.arange(len(x)), k)
            z = (x - model.mean) @ scaled.T
            yield pa.RecordBatch.from_arrays(
                [
                    column(batch, "row").take(pa.array(place)),
                    pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(x))),
                    pa.array(np.full(len(place), model.n, np.int64)),
                    pa.array(exact_deviation(x, model.n, model.sums), pa.int64()).take(pa.array(place)),
                    pa.array(z.ravel()),
                    pa.array(np.tile(explained, len(x))),
                    pa.array(np.full(len(place), model.identity_error)),
                ],
                names=["row", "component", "n", "deviation", "whitened", "explained", "identity_error"],
            )

    return packed.mapInArrow(
        task,
        schema_of(packed.schema["row"], "component int, n long, deviation long, whitened double, explained double, identity_error double"),
    )
