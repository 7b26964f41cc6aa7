"""K-means on weighted patterns: greedy seeding and restarts that share every pass.

Rows with equal features are one weighted pattern. All restarts advance together, so a pass over the
patterns serves each of them, in seeding as in the iterations, and only sums and drawn centres of the
size of the model leave the executors.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.storagelevel import StorageLevel

from wardstat.operators.passes import column, matrix, summed_arrays
from wardstat.session import materialize, ship_code


@dataclass(frozen=True)
class KMeansFit:
    """The best restart: centres, weighted sum of squared distances, iterations, and rows fitted."""

    features: list[str]
    centers: np.ndarray
    inertia: float
    iterations: int
    n_rows: int

    @property
    def k(self) -> int:
        return len(self.centers)

    def transform(self, df: DataFrame, name: str = "cluster") -> DataFrame:
        """Add the number of the nearest centre; NULL where a feature is missing, ties go to the first centre."""
        return df.withColumn(name, nearest_center(self.features, self.centers))


def squared_distances(features: Sequence[str], centers: np.ndarray) -> list[Column]:
    """Squared distance of a row to each centre."""
    return [
        sum(((F.col(f"`{f}`").cast("double") - F.lit(float(v))) * (F.col(f"`{f}`").cast("double") - F.lit(float(v))) for f, v in zip(features, c)), F.lit(0.0))
        for c in centers
    ]


def nearest_center(features: Sequence[str], centers: np.ndarray) -> Column:
    """Number of the nearest centre, in expressions."""
    found = F.transform(
        F.array(F.array(*squared_distances(features, centers))),
        lambda d: F.array_position(d, F.array_min(d)).cast("int") - 1,
    )
    place = F.get(found, F.lit(0))
    known = [F.col(f"`{f}`").isNotNull() for f in features]
    return F.when(F.array_min(F.array(*known)), place)


def weighted_points(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """Distinct complete feature vectors as (_x, _w), written once."""
    x = F.array(*[F.col(f"`{f}`").cast("double") for f in features])
    complete = df.select(x.alias("_x")).where(~F.exists("_x", lambda v: v.isNull() | F.isnan(v)))
    return materialize(complete.groupBy("_x").agg(F.count(F.lit(1)).cast("double").alias("_w")))


def lloyd_step(df: DataFrame, features: Sequence[str], centers: np.ndarray) -> DataFrame:
    """One iteration from fixed centres as a grouped aggregate: (cluster, n, inertia, mean of each feature).

    Rows with a missing feature are left out; a cluster without rows gives no row.
    """
    complete = df.select(*[F.col(f"`{f}`").cast("double").alias(f) for f in features]).na.drop()
    assigned = complete.withColumn("cluster", nearest_center(features, centers))
    distance = F.array_min(F.array(*squared_distances(features, centers)))
    return assigned.groupBy("cluster").agg(
        F.count(F.lit(1)).alias("n"), F.sum(distance).alias("inertia"), *[F.avg(f"`{f}`").alias(f) for f in features]
    )


def _distances(x: np.ndarray, centers: np.ndarray) -> np.ndarray:
    """Squared distances, rows by centres, from differences, so that equal points are exactly 0 apart."""
    return np.stack([((x - c) ** 2).sum(axis=1) for c in centers], axis=1)


def _point_hashes(x: np.ndarray) -> np.ndarray:
    """A number for each point that depends on its coordinates only."""
    bits = (x + 0.0).view(np.uint64)
    with np.errstate(over="ignore"):
        h = np.zeros(len(x), np.uint64)
        for j in range(x.shape[1]):
            h = _mix(h * np.uint64(0x9E3779B97F4A7C15) + bits[:, j])
    return h


def _uniform(hashes: np.ndarray, salts: np.ndarray) -> np.ndarray:
    """Numbers in (0, 1) for every point and salt."""
    with np.errstate(over="ignore"):
        mixed = _mix(hashes[:, None] ^ salts[None, :])
    return ((mixed >> np.uint64(12)).astype(float) + 0.5) / float(1 << 52)


def _mix(v: np.ndarray) -> np.ndarray:
    v = (v ^ (v >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    v = (v ^ (v >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return v ^ (v >> np.uint64(31))


def _drawn(points: DataFrame, centers: dict[int, np.ndarray], salts: dict[int, np.ndarray]) -> dict[int, tuple[float, np.ndarray]]:
    """For each slot the weighted sum of squared distances, and a point drawn for each of its salts.

    Points are drawn in proportion to weight and squared distance to the slot's centres, or to weight
    alone where it has none. The smallest of exponential variables with these rates is such a draw;
    a task keeps its smallest one for each salt, and the tasks' are compared on the executors.
    """

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[tuple[int, int], tuple[float, np.ndarray]] = {}
        cost = dict.fromkeys(centers, 0.0)
        for batch in batches:
            if not batch.num_rows:
                continue
            x, w = matrix(batch, "_x"), column(batch, "_w")
            hashes = _point_hashes(x)
            for slot, c in centers.items():
                rate = w * (_distances(x, c).min(axis=1) if len(c) else 1.0)
                cost[slot] += float(rate.sum())
                with np.errstate(divide="ignore"):
                    keys = -np.log(_uniform(hashes, salts[slot])) / rate[:, None]
                for t, row in enumerate(keys.argmin(axis=0)):
                    if (slot, t) not in best or keys[row, t] < best[slot, t][0]:
                        best[slot, t] = (float(keys[row, t]), x[row])
        if best:
            yield pa.RecordBatch.from_pydict(
                {
                    "slot": pa.array([s for s, _ in best], pa.int32()),
                    "trial": pa.array([t for _, t in best], pa.int32()),
                    "cost": pa.array([cost[s] for s, _ in best]),
                    "key": pa.array([k for k, _ in best.values()]),
                    "x": pa.array([p.tolist() for _, p in best.values()], pa.list_(pa.float64())),
                }
            )

    ship_code(points.sparkSession)
    found = points.mapInArrow(task, "slot int, trial int, cost double, key double, x array<double>")
    rows = found.groupBy("slot", "trial").agg(F.sum("cost"), F.min_by("x", F.struct("key", "x"))).collect()
    drawn: dict[int, list] = {}
    for slot, _, total, x in sorted(rows, key=lambda r: (r[0], r[1])):
        drawn.setdefault(slot, []).append((total, x))
    return {slot: (found[0][0], np.array([x for _, x in found])) for slot, found in drawn.items()}


def seed_centers(points: DataFrame, k: int, restarts: int, seed: int) -> list[np.ndarray]:
    """Greedy seeding: of a few points drawn by squared distance, the one that lowers the sum most joins.

    One pass measures the candidates of every restart and draws the candidates that follow each of
    them, so a centre costs one pass.
    """
    rng = np.random.default_rng(seed)
    trials = 2 + int(np.log(k))

    def salts(slots, each: int) -> dict[int, np.ndarray]:
        return {s: rng.integers(0, 1 << 63, each, dtype=np.uint64) for s in slots}

    every = range(restarts)
    first = _drawn(points, {r: np.empty((0, 0)) for r in every}, salts(every, 1))
    centers = [first[r][1] for r in every]
    if k == 1:
        return centers
    drawn = _drawn(points, dict(enumerate(centers)), salts(every, trials))
    candidates = [drawn[r][1] for r in every]
    for _ in range(1, k):
        widened = {r * trials + t: np.vstack([centers[r], candidates[r][t]]) for r in every for t in range(trials)}
        drawn = _drawn(points, widened, salts(widened, trials))
        for r in every:
            best = min(range(r * trials, (r + 1) * trials), key=lambda s: drawn[s][0])
            centers[r], candidates[r] = widened[best], drawn[best][1]
    return centers


def kmeans_fit(
    df: DataFrame,
    features: Sequence[str],
    k: int,
    seed: int = 0,
    restarts: int = 4,
    max_iter: int = 300,
    tol: float = 1e-4,
) -> KMeansFit:
    """The best of ``restarts`` greedy seedings after Lloyd iterations on the complete rows of ``df``.

    A restart ends when its centres move by no more than ``tol`` times the mean variance of the
    features (summed over squares), or after ``max_iter`` passes. A centre without points stays where
    it is. With fewer distinct points than ``k`` every point is a centre. Centres are ordered by their
    coordinates.
    """
    points = weighted_points(df, features).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        d = len(features)

        def moments(batch: pa.RecordBatch) -> dict[int, np.ndarray]:
            x, w = matrix(batch, "_x"), column(batch, "_w")
            return {0: np.concatenate([[len(w), w.sum()], w @ x, w @ x**2])}

        found = summed_arrays(points, 0, moments)
        if not found:
            raise ValueError("no complete row to cluster")
        distinct, n = int(found[0][0]), float(found[0][1])
        mean, square = found[0][2 : 2 + d] / n, found[0][2 + d :] / n
        limit = tol * float(np.mean(np.maximum(square - mean**2, 0.0)))
        centers = seed_centers(points, min(k, distinct), restarts, seed)
        inertia, iterations = np.full(restarts, np.inf), np.zeros(restarts, int)
        active, settled = list(range(restarts)), set()
        while active:
            current = {r: centers[r] for r in active}

            def sums(batch: pa.RecordBatch) -> dict[int, np.ndarray]:
                x, w = matrix(batch, "_x"), column(batch, "_w")
                weighed = np.column_stack([w, x * w[:, None]])
                out = {}
                for r, c in current.items():
                    distance = _distances(x, c)
                    near = distance.argmin(axis=1)
                    member = np.zeros((len(c), len(x)))
                    member[near, np.arange(len(x))] = 1.0
                    out[r] = np.concatenate([[w @ distance.min(axis=1)], (member @ weighed).ravel()])
                return out

            for r, total in summed_arrays(points, 0, sums).items():
                inertia[r] = total[0]  # of the centres before they move
                table = total[1:].reshape(-1, d + 1)
                held = table[:, :1] > 0
                moved = np.where(held, table[:, 1:] / np.where(held, table[:, :1], 1.0), centers[r])
                shift = float(((moved - centers[r]) ** 2).sum())
                iterations[r] += 1
                if r in settled or shift == 0 or iterations[r] >= max_iter:
                    active.remove(r)
                    continue
                # One more pass measures the centres that a restart ends with.
                centers[r] = moved
                if shift <= limit:
                    settled.add(r)
        best = int(np.argmin(inertia))
        order = np.lexsort(centers[best].T[::-1])
        return KMeansFit(list(features), centers[best][order], float(inertia[best]), int(iterations[best]), int(n))
    finally:
        points.unpersist()
