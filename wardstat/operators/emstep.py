"""One step of expectation and maximisation as joins and grouped sums, from a table of parameters.

The fit in :mod:`wardstat.operators.latent` runs many such steps over arrays; this form keeps the
parameters in a table, so that a step can be written, inspected and continued like any other data, and
so that a model of any size is joined rather than shipped.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wardstat.operators.cohort import complete_cases
from wardstat.operators.factors import cells
from wardstat.session import materialize, small_side

# A class probability below this counts as this in logarithms, so impossible levels stay finite.
TINY = 1e-300


def answer_patterns(df: DataFrame, variables: Sequence[str], weight: str = "n") -> DataFrame:
    """Distinct answers of the rows that have all of them, and how many rows give each."""
    return complete_cases(df.select(*variables), variables).groupBy(*variables).agg(F.count(F.lit(1)).alias(weight))


def weighted_patterns(df: DataFrame, variables: Sequence[str]) -> DataFrame:
    """Distinct answers of the complete rows as (id, cells, w), written once; ids are those of the written rows."""
    usable = complete_cases(df.select(*variables), variables)
    grouped = materialize(usable.groupBy(cells(variables).alias("cells")).agg(F.count(F.lit(1)).alias("w")))
    return grouped.select(F.monotonically_increasing_id().alias("id"), "cells", F.col("w").cast("double").alias("w"))


def _log(p: Column) -> Column:
    return F.log(F.greatest(p, F.lit(TINY)))


def _answers(params: DataFrame, classes: int) -> DataFrame:
    """One row per (variable, level) with the logarithms of its class probabilities and of the shares, class 1 first."""
    per_class = [
        (F.max(F.when(F.col("class") == c, _log(F.col("prob")))), F.max(F.when(F.col("class") == c, _log(F.col("share")))))
        for c in range(1, classes + 1)
    ]
    return params.groupBy("variable", "level").agg(
        F.array(*[p for p, _ in per_class]).alias("log_prob"), F.array(*[s for _, s in per_class]).alias("log_share")
    )


def expectation(patterns: DataFrame, params: DataFrame, classes: int) -> DataFrame:
    """Class probabilities of every pattern: (id, log_density, posterior), by a stable log-sum-exp.

    Patterns with an answer that the parameters do not know are left out.
    """
    answers = small_side(_answers(params, classes))
    exploded = patterns.select("id", F.size("cells").alias("asked"), F.explode("cells").alias("cell"))
    matched = exploded.join(answers, (F.col("cell.variable") == F.col("variable")) & (F.col("cell.level") == F.col("level")))
    # The cells of a pattern lie in one task, so the sums are complete before the exchange.
    sums = matched.groupBy("id").agg(
        F.count(F.lit(1)).alias("answered"),
        F.max("asked").alias("asked"),
        *[(F.max(F.col("log_share")[c]) + F.sum(F.col("log_prob")[c])).alias(f"j{c}") for c in range(classes)],
    )
    joint = [F.col(f"j{c}") for c in range(classes)]
    topped = sums.where("answered = asked").withColumn("top", F.greatest(*joint) if classes > 1 else joint[0])
    mass = sum((F.exp(j - F.col("top")) for j in joint[1:]), F.exp(joint[0] - F.col("top")))
    dense = topped.withColumn("log_density", F.col("top") + F.log(mass))
    return dense.select("id", "log_density", F.array(*[F.exp(j - F.col("log_density")) for j in joint]).alias("posterior"))


def maximisation(patterns: DataFrame, posteriors: DataFrame, params: DataFrame, classes: int) -> DataFrame:
    """The next parameters: weighted sums of the posteriors per answer, over those per class."""
    weighed = patterns.join(posteriors, "id").select(F.explode("cells").alias("cell"), "w", "log_density", "posterior")
    counts = weighed.groupBy("cell.variable", "cell.level").agg(
        F.sum(F.col("w") * F.col("log_density")).alias("_level_likelihood"),
        F.array(*[F.sum(F.col("w") * F.col("posterior")[c]) for c in range(classes)]).alias("_n"),
    )
    # Model-sized from here on. A row answers every variable once, so each variable holds all the mass.
    known = params.join(counts, ["variable", "level"], "left").withColumn("_n", F.coalesce(F.get("_n", F.col("class") - 1), F.lit(0.0)))
    of_class, of_variable = Window.partitionBy("variable", "class"), Window.partitionBy("variable")
    one_class = F.col("class") == 1
    summed = known.select(
        "class",
        "variable",
        "level",
        "prob",
        F.col("_n"),
        F.sum("_n").over(of_class).alias("_mass"),
        F.sum("_n").over(of_variable).alias("_all"),
        F.sum(F.when(one_class, F.coalesce("_level_likelihood", F.lit(0.0)))).over(of_variable).alias("log_likelihood"),
    )
    return summed.select(
        "class",
        (F.col("_mass") / F.nullif(F.col("_all"), F.lit(0.0))).alias("share"),
        "variable",
        "level",
        F.when(F.col("_mass") > 0, F.col("_n") / F.col("_mass")).otherwise(F.col("prob")).alias("prob"),
        "log_likelihood",
    )


def lca_em_step(df: DataFrame, params: DataFrame, patterns: DataFrame | None = None) -> DataFrame:
    """One EM step of the latent class model from the parameters in a table.

    ``params`` has one row per (class, variable, level), classes numbered from 1, as
    ``LatentClassModel.parameters`` gives them. Returns the updated table and, in every row, the
    log-likelihood of the parameters given. Incomplete rows and rows with a level that the table does not
    know are left out; a class that no row supports keeps its probabilities. Several steps can share
    ``patterns`` (from :func:`weighted_patterns`).
    """
    shape = params.agg(F.max("class"), F.collect_set("variable")).first()  # model-sized
    if shape[0] is None:
        raise ValueError("the parameter table is empty")
    classes, variables = shape[0], sorted(shape[1])
    if patterns is None:
        patterns = weighted_patterns(df, variables)
    return maximisation(patterns, expectation(patterns, params, classes), params, classes)


def log_likelihood(patterns: DataFrame, params: DataFrame, classes: int) -> DataFrame:
    """One row (log_likelihood, n_rows) of the rows that a parameter table can score."""
    weighed = patterns.select("id", "w").join(expectation(patterns, params, classes).select("id", "log_density"), "id")
    return weighed.agg(F.sum(F.col("w") * F.col("log_density")).alias("log_likelihood"), F.sum("w").cast("bigint").alias("n_rows"))
