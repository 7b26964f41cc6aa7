"""Cross-validated one-vs-all discrimination of classes."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType
from pyspark.storagelevel import StorageLevel

from wardstat.operators.ordered import null_safe_join, running_totals
from wardstat.operators.passes import column, matrix, summed_arrays
from wardstat.operators.roc import auc_score, roc_points
from wardstat.session import materialize, ship_code, small_side


def stratified_folds(
    df: DataFrame,
    stratum: str,
    id_cols: Sequence[str],
    folds: int = 10,
    cells: int | None = None,
    order_col: str | None = None,
) -> DataFrame:
    """Add ``fold`` so that every stratum is spread over the folds to within one row.

    Rows are ordered by a hash of their id. A row's position in its stratum is its position in
    its hash cell plus the size of the cells before it, so a large stratum is ordered in
    ``cells`` pieces instead of one; by default there are more of them the more partitions a
    shuffle has. With ``order_col`` the folds are runs along that column instead. Rows without a
    stratum are a stratum of their own.
    """
    if order_col is not None:
        one = df.withColumn("_one", F.lit(1).cast("bigint"))
        ranked = running_totals(one, [order_col, *id_cols], {"_one": "_upto"}, stratum, whole={"_one": "_size"})
        fold = F.floor((F.col("_upto") - 1) * folds / F.col("_size")).cast("int")
        return ranked.select(*df.columns, fold.alias("fold"))
    if cells is None:
        cells = 1 << max(12, (64 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))).bit_length())
    hashed = F.xxhash64(*id_cols)
    placed = df.withColumns({"_hash": hashed, "_cell": F.shiftrightunsigned(hashed, 32).bitwiseAND(F.lit(cells - 1))})
    sizes = placed.groupBy(stratum, "_cell").agg(F.count(F.lit(1)).alias("_size"))
    before = Window.partitionBy(stratum).orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
    offsets = small_side(
        sizes.select(
            stratum,
            "_cell",
            F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_before"),
            F.sum("_size").over(Window.partitionBy(stratum)).alias("_stratum_size"),
        )
    )
    inside = Window.partitionBy(stratum, "_cell").orderBy("_hash", *id_cols)
    ranked = null_safe_join(placed, offsets, [stratum, "_cell"]).withColumn(
        "_rank", F.col("_before") + F.row_number().over(inside) - 1
    )
    fold = F.floor(F.col("_rank") * folds / F.col("_stratum_size")).cast("int")
    return ranked.select(*df.columns, fold.alias("fold"))


def one_vs_all(class_col: str, target) -> Column:
    """1 for the rows of a class and 0 for those of all others; NULL without a class."""
    return (F.col(class_col) == F.lit(target)).cast("int")


def fold_bounds(first: int, other: int, folds: int) -> tuple[list[int], list[int]]:
    """For the label of the first row and for the other one: the rank at which each fold after the first begins.

    Labels are laid out one after the other and dealt to the folds in turn; that gives each fold's
    number of rows of a label, and a label's rows fill the folds in their order.
    """

    def dealt(begin: int, end: int) -> list[int]:
        sizes = [(end + folds - 1 - i) // folds - (begin + folds - 1 - i) // folds for i in range(folds)]
        return np.cumsum(sizes)[:-1].tolist()

    return dealt(0, first), dealt(first, first + other)


def ordered_folds(
    df: DataFrame,
    class_col: str,
    order: Sequence[str],
    folds: int = 10,
    name: str = "folds",
) -> DataFrame:
    """Add the fold of every one-vs-all target as an array, stratified without shuffling.

    The folds are those of a stratified split of the rows along ``order``, made for the target "is of
    class c" of each class c in ascending order. ``order`` must tell all rows apart: a row number
    from :mod:`wardstat.sources.positional` keeps the order of a file. Rows without a class are left
    out. Ranks come from running totals in slices, so neither a class nor the table meets in one task.
    """
    usable = df.where(F.col(class_col).isNotNull())
    sizes = {c: n for c, n in usable.groupBy(class_col).agg(F.count(F.lit(1))).collect()}  # one row per class
    classes, rows = sorted(sizes), sum(sizes.values())
    if not classes:
        return usable.withColumn(name, F.array().cast("array<int>"))
    marked = usable.withColumns(
        {"_one": F.lit(1).cast("bigint"), **{f"_is{k}": one_vs_all(class_col, c).cast("bigint") for k, c in enumerate(classes)}}
    )
    totals = {"_one": "_upto", **{f"_is{k}": f"_upto{k}" for k in range(len(classes))}}
    ranked = running_totals(marked, order, totals)
    leader = ranked.where("_upto = 1").select(class_col).first()[0]

    def fold(k: int, c) -> Column:
        own, rest = sizes[c], rows - sizes[c]
        if c == leader:
            bounds_own, bounds_rest = fold_bounds(own, rest, folds)
        else:
            bounds_rest, bounds_own = fold_bounds(rest, own, folds)

        def count(rank: Column, bounds: list[int]) -> Column:
            return sum(((rank > b).cast("int") for b in bounds), F.lit(0))

        is_own = F.col(f"_is{k}") == 1
        return F.when(is_own, count(F.col(f"_upto{k}"), bounds_own)).otherwise(
            count(F.col("_upto") - F.col(f"_upto{k}"), bounds_rest)
        )

    return ranked.select(*df.columns, F.array(*[fold(k, c) for k, c in enumerate(classes)]).alias(name))


def target_folds(folded: DataFrame, class_col: str, ids: Sequence[str], name: str = "folds") -> DataFrame:
    """The folds of :func:`ordered_folds` as rows (ids, target, fold)."""
    classes = sorted(r[0] for r in folded.select(class_col).distinct().collect())  # one row per class
    long = folded.select(*ids, F.posexplode(name).alias("_k", "fold"))
    target = F.get(F.array(*[F.lit(c) for c in classes]), F.col("_k")) if classes else F.lit(None)
    return long.select(*ids, target.alias("target"), "fold")


def out_of_fold_counts(
    df: DataFrame,
    features: Sequence[str],
    class_col: str = "class_assignment",
    fold_col: str = "fold",
    inverse_penalty: float = 1.0,
    max_iter: int = 1000,
    tol: float = 1e-8,
) -> DataFrame:
    """Held-out logistic scores of every class against the rest, as counts per score.

    The penalised log-likelihood (unpenalised intercept, penalty ``1 / inverse_penalty`` on the
    unscaled weights) has one maximum per class and fold. Newton steps reach all of them
    together: a step costs one pass over the data for all classes and folds, where separate
    fits would need a pass per step, class and fold. Rows with equal features, class and fold
    are collapsed to one weighted row first. ``fold_col`` is one fold for all targets, or an array with
    the fold for each class (from :func:`ordered_folds`).

    Returns (class, threshold, pos, neg), ready for :mod:`wardstat.operators.roc`.
    """
    per_target = isinstance(df.schema[fold_col].dataType, ArrayType)
    collapsed = (
        df.na.drop(subset=[*features, class_col])
        .where(F.col(fold_col).isNotNull())
        .groupBy(
            F.array(*[F.col(f).cast("double") for f in features]).alias("_x"),
            F.col(class_col).alias("_class"),
            (F.col(fold_col) if per_target else F.array(F.col(fold_col).cast("int"))).alias("_fold"),
        )
        .agg(F.count(F.lit(1)).cast("double").alias("_w"))
    )
    # Dealt out evenly, since a Newton step computes far more than it reads.
    spread = collapsed.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    rows = materialize(spread).persist(StorageLevel.MEMORY_AND_DISK)
    # One row per class, and as many folds as there are.
    seen = rows.agg(F.sort_array(F.collect_set("_class")), F.max(F.array_max("_fold"))).first()
    classes, folds = seen[0], list(range((seen[1] if seen[1] is not None else -1) + 1))
    fits = _newton(rows, len(features), classes, folds, inverse_penalty, max_iter, tol)
    scored = materialize(_held_out(rows, classes, folds, fits, class_col))
    rows.unpersist()
    return scored


def _newton(rows, n_features, classes, folds, inverse_penalty, max_iter, tol) -> np.ndarray:
    """Weights of every class and fold, indexed by both."""
    width = n_features + 1
    slots = [(ci, f) for ci in range(len(classes)) for f in folds]
    beta = np.zeros((len(slots), width))
    ridge = np.full(width, 1.0 / inverse_penalty)
    ridge[0] = 0.0
    upper = np.triu_indices(width)
    active = list(range(len(slots)))
    best = np.full(len(slots), np.inf)
    step = np.zeros_like(beta)
    for _ in range(max_iter):
        if not active:
            break
        current, chosen = beta[active].copy(), [slots[i] for i in active]
        found = summed_arrays(rows, 0, lambda batch: {0: _derivatives(batch, classes, chosen, current)})
        if not found:
            break
        sums = found[0].reshape(len(active), -1)
        still = []
        for i, total in zip(active, sums):
            loss = total[0] + 0.5 * ridge @ beta[i] ** 2
            if loss > best[i] + 1e-9 * abs(best[i]):
                # The last step overshot: go back half of it.
                step[i] /= 2.0
                beta[i] -= step[i]
                still.append(i)
                continue
            best[i] = loss
            gradient = total[1 : 1 + width] + ridge * beta[i]
            hessian = np.diag(ridge)
            hessian[upper] += total[1 + width :]
            hessian = np.triu(hessian) + np.triu(hessian, 1).T
            step[i] = -np.linalg.lstsq(hessian, gradient, rcond=None)[0]
            beta[i] += step[i]
            if -gradient @ step[i] > tol:
                still.append(i)
        active = still
    return beta.reshape(len(classes), len(folds), width)


def _design(batch: pa.RecordBatch) -> np.ndarray:
    return np.insert(matrix(batch, "_x"), 0, 1.0, axis=1)


def _fold_of(batch: pa.RecordBatch, n_classes: int) -> np.ndarray:
    """Fold of each row for each class; one shared fold counts for all of them."""
    fold = matrix(batch, "_fold")
    return np.broadcast_to(fold, (len(fold), n_classes)) if fold.shape[1] == 1 else fold


def _derivatives(batch: pa.RecordBatch, classes: list, slots: list, beta: np.ndarray) -> np.ndarray:
    """Loss, gradient and curvature (upper triangle) of every model on the rows outside its fold.

    All models share the products of the features, so the curvatures are one matrix product.
    """
    x = _design(batch)
    fold, weight = _fold_of(batch, len(classes)), column(batch, "_w")
    label = np.searchsorted(classes, column(batch, "_class"))
    target, held_out = (np.array(side) for side in zip(*slots))
    w = weight[:, None] * (fold[:, target] != held_out)
    y = (label[:, None] == target).astype(float)
    eta = x @ beta.T
    p = 1.0 / (1.0 + np.exp(-np.clip(eta, -500, 500)))
    loss = (w * (np.logaddexp(0.0, eta) - y * eta)).sum(axis=0)
    a, b = np.triu_indices(x.shape[1])
    curvature = (w * p * (1.0 - p)).T @ (x[:, a] * x[:, b])
    return np.concatenate([loss[:, None], (w * (p - y)).T @ x, curvature], axis=1)


def _held_out(rows, classes, folds, fits: np.ndarray, class_col: str) -> DataFrame:
    """Score every row by the models that did not see its fold, then count per class and score."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _design(batch)
            fold = _fold_of(batch, len(classes)).astype(int)
            label, weight = column(batch, "_class"), column(batch, "_w")
            for i, c in enumerate(classes):
                eta = np.einsum("ij,ij->i", x, fits[i][fold[:, i]])
                yield pa.RecordBatch.from_pydict(
                    {
                        class_col: pa.array(np.full(len(label), c), pa.int64()),
                        "threshold": pa.array(1.0 / (1.0 + np.exp(-np.clip(eta, -500, 500)))),
                        "pos": pa.array(np.where(label == c, weight, 0.0)),
                        "neg": pa.array(np.where(label == c, 0.0, weight)),
                    }
                )

    ship_code(rows.sparkSession)
    scored = rows.mapInArrow(task, f"{class_col} bigint, threshold double, pos double, neg double")
    return scored.groupBy(class_col, "threshold").agg(
        F.sum("pos").cast("bigint").alias("pos"), F.sum("neg").cast("bigint").alias("neg")
    )


def class_scores(
    df: DataFrame,
    features: Sequence[str],
    class_col: str = "class_assignment",
    id_cols: Sequence[str] = ("subject_id", "hadm_id"),
    folds: int = 10,
    order: Sequence[str] | None = None,
) -> DataFrame:
    """Held-out counts per class and score; with ``order`` the folds follow it, target by target."""
    # Written once: class sizes, ranks and features all read it.
    known = materialize(df.where(F.col(class_col).isNotNull()).select(*dict.fromkeys([*features, class_col, *(id_cols if order is None else order)])))
    if order is not None:
        return out_of_fold_counts(ordered_folds(known, class_col, order, folds), features, class_col, "folds")
    folded = stratified_folds(known, class_col, id_cols, folds)
    return out_of_fold_counts(folded, features, class_col)


def class_auc(counts: DataFrame, class_col: str = "class_assignment") -> DataFrame:
    """Cross-validated area per class, from :func:`class_scores`."""
    return auc_score(counts, class_col)


def class_roc(counts: DataFrame, class_col: str = "class_assignment", prune: bool = False) -> DataFrame:
    """Cross-validated curve per class, from :func:`class_scores`."""
    return roc_points(counts, class_col, prune)
