"""Loss, gradient and curvature of one-vs-all logistic models at given weights, as grouped sums."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wardstat.operators.roc import score_counts

#: Name of the constant term.
INTERCEPT = "intercept"


def design(features: Sequence[str]) -> Column:
    """The constant term and the features as one array."""
    return F.array(F.lit(1.0), *[F.col(f"`{f}`").cast("double") for f in features])


def _linear(x: Column, weights: Column) -> Column:
    return F.aggregate(F.zip_with(x, weights, lambda a, b: a * b), F.lit(0.0), lambda total, v: total + v)


def _targets(weights: Mapping[int, Sequence[float]]) -> Column:
    """One entry per class with its weights."""
    return F.array(*[
        F.struct(F.lit(c).alias("class"), F.lit([float(v) for v in w]).alias("weights")) for c, w in sorted(weights.items())
    ])


def class_counts(
    df: DataFrame, features: Sequence[str], weights: Mapping[int, Sequence[float]], class_col: str = "class_assignment"
) -> DataFrame:
    """Scores of every class's model at given weights, as counts per class and score.

    The score is the linear predictor, which orders rows as the probability does. Returns (class,
    threshold, pos, neg), ready for :mod:`wardstat.operators.roc`. Rows with a missing feature or class
    are left out; equal rows are collapsed before the classes multiply them.
    """
    complete = df.na.drop(subset=[*features, class_col])
    collapsed = complete.groupBy(design(features).alias("_x"), F.col(class_col).alias("_class")).agg(F.count(F.lit(1)).alias("_w"))
    exploded = collapsed.select("_x", "_class", "_w", F.explode(_targets(weights)).alias("_target"))
    scored = exploded.select(
        F.col("_target.class").alias(class_col),
        _linear(F.col("_x"), F.col("_target.weights")).alias("score"),
        (F.col("_class") == F.col("_target.class")).cast("int").alias("label"),
        "_w",
    )
    return score_counts(scored, group=class_col, weight="_w")


def _products(x: Column, target: Column, label: Column, weight: Column) -> Column:
    """Loss, gradient and the upper triangle of the curvature of one row, in one array."""
    eta = _linear(x, target["weights"])
    y = F.when(label == target["class"], 1.0).otherwise(0.0)

    def parts(e: Column) -> Column:
        p = 1.0 / (1.0 + F.exp(-e))
        # log(1 + exp(e)) without overflow
        loss = F.greatest(e, F.lit(0.0)) + F.log1p(F.exp(-F.abs(e))) - y * e
        return F.array(weight * loss, weight * (p - y), weight * p * (1.0 - p))

    def together(s: Column) -> Column:
        gradient = F.transform(x, lambda a: a * s[1])
        rows = F.transform(x, lambda a, i: F.transform(F.slice(x, i + 1, F.size(x)), lambda b: a * b * s[2]))
        return F.concat(F.array(s[0]), gradient, F.flatten(rows))

    whole = F.transform(F.transform(F.array(eta), parts), together)
    return F.get(whole, F.lit(0))


def logit_sums(
    df: DataFrame,
    features: Sequence[str],
    weights: Mapping[int, Sequence[float]],
    class_col: str = "class_assignment",
    fold_col: str = "fold",
) -> DataFrame:
    """Sums that a Newton step of each class and fold needs, over the rows outside the fold.

    ``weights`` maps a class to its weights, the constant term first. Returns one row per class, fold and
    entry: ``quantity`` is ``loss`` (no terms), ``gradient`` (``term_a``) or ``curvature``
    (``term_a``, ``term_b``, upper triangle), without penalty. Rows with a missing feature, class or fold are
    left out. Equal rows are collapsed first; one grouped aggregate then sums the products of all
    classes, and the sums outside a fold are those of all folds less its own.
    """
    names = [INTERCEPT, *features]
    complete = df.na.drop(subset=[*features, class_col, fold_col])
    collapsed = complete.groupBy(design(features).alias("_x"), F.col(class_col).alias("_class"), F.col(fold_col).alias("fold")).agg(
        F.count(F.lit(1)).cast("double").alias("_w")
    )
    exploded = collapsed.select("_x", "_class", "fold", "_w", F.explode(_targets(weights)).alias("_target"))
    products = _products(F.col("_x"), F.col("_target"), F.col("_class"), F.col("_w"))
    summed = exploded.select(F.col("_target.class").alias(class_col), "fold", array_to_vector(products).alias("_v")).groupBy(
        class_col, "fold"
    ).agg(Summarizer.sum(F.col("_v")).alias("_v"))
    # Model-sized from here on.
    entries = summed.select(class_col, "fold", F.posexplode(vector_to_array(F.col("_v"))).alias("_at", "_own"))
    outside = F.sum("_own").over(Window.partitionBy(class_col, "_at")) - F.col("_own")
    labels = [("loss", None, None)] + [("gradient", a, None) for a in names]
    labels += [("curvature", a, b) for i, a in enumerate(names) for b in names[i:]]
    text = lambda k: F.get(F.array(*[F.lit(row[k]).cast("string") for row in labels]), F.col("_at"))
    return entries.select(
        class_col, "fold", text(0).alias("quantity"), text(1).alias("term_a"), text(2).alias("term_b"), outside.alias("value")
    )
