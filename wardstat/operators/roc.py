"""Exact ROC curves and areas from scored rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardstat.operators.ordered import running_totals


def score_counts(
    df: DataFrame, score: str = "score", label: str = "label", group: str | None = None, weight: str | None = None
) -> DataFrame:
    """Positives and negatives per distinct score (and group); rows without score (NaN counts as none) or label drop out."""
    lead = [group] if group else []
    w = F.lit(1).cast("bigint") if weight is None else F.col(weight)
    known = F.col(score).isNotNull() & ~F.isnan(F.col(score).cast("double"))
    usable = df.where(known & F.col(label).isNotNull())
    return usable.groupBy(*lead, F.col(score).alias("threshold")).agg(
        F.sum(F.when(F.col(label) == 1, w).otherwise(F.lit(0))).alias("pos"),
        F.sum(F.when(F.col(label) == 1, F.lit(0)).otherwise(w)).alias("neg"),
    )


def _cumulated(counts: DataFrame, group: str | None, following: dict[str, str] | None = None) -> DataFrame:
    sums = {"pos": "tp", "neg": "fp"}
    return running_totals(
        counts, ["threshold"], sums, group, descending=True, whole={"pos": "p", "neg": "n"}, following=following
    )


def roc_points(counts: DataFrame, group: str | None = None, prune: bool = False) -> DataFrame:
    """One point per distinct score, highest first: (threshold, fpr, tpr), without the origin.

    ``counts`` comes from :func:`score_counts`. With ``prune`` a point goes where the step to it and
    the step from it are the same, for it lies in the middle of a straight piece; the first and the
    last point stay, and so does the area.
    """
    if prune:
        points = _cumulated(counts, group, {"pos": "_next_pos", "neg": "_next_neg"})
        last = F.col("_next_pos").isNull()
        first = (F.col("tp") == F.col("pos")) & (F.col("fp") == F.col("neg"))
        turns = (F.col("_next_pos") != F.col("pos")) | (F.col("_next_neg") != F.col("neg"))
        points = points.where(first | last | turns)
    else:
        points = _cumulated(counts, group)
    return points.select(
        *([group] if group else []),
        "threshold",
        (F.col("fp") / F.nullif(F.col("n"), F.lit(0))).alias("fpr"),
        (F.col("tp") / F.nullif(F.col("p"), F.lit(0))).alias("tpr"),
    )


def auc_score(counts: DataFrame, group: str | None = None) -> DataFrame:
    """Area under the curve by trapezoids over the distinct scores; ties count one half.

    NULL where one of the two labels is absent.
    """
    lead = [group] if group else []
    pos, neg = F.col("pos").cast("double"), F.col("neg").cast("double")
    area = F.sum(neg * (F.col("tp").cast("double") - pos / 2.0))
    pairs = F.sum(pos) * F.sum(neg)
    return _cumulated(counts, group).groupBy(*lead).agg(
        F.sum("pos").alias("positives"),
        F.sum("neg").alias("negatives"),
        (area / F.nullif(pairs, F.lit(0.0))).alias("auc"),
    )
