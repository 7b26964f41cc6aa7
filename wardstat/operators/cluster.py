"""K-means on rows or on group profiles."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardstat.functions.labels import age_bins
from wardstat.functions.temporal import as_column
from wardstat.operators.kmeans import KMeansFit, kmeans_fit
from wardstat.operators.prevalence import group_profile
from wardstat.session import materialize
from wardstat.sources.tables import FLAGS


def male(gender: Column | str) -> Column:
    """Gender as a number: 1 for male, 0 for any other value and for none."""
    return F.coalesce((as_column(gender) == "M").cast("double"), F.lit(0.0))


def kmeans_rows(
    df: DataFrame,
    flags: Sequence[str] = FLAGS,
    k: int = 6,
    include_gender: bool = False,
    bin_age: bool = False,
    seed: int = 0,
) -> tuple[KMeansFit, DataFrame]:
    """Cluster rows on unscaled flags and age, optionally on gender (male = 1) as well.

    Rows with a missing flag or age have no cluster.
    """
    rows = df.withColumn("gender", male("gender"))
    columns = [*flags, "age_at_admission", *(["gender"] if include_gender else [])]
    # Written once: the fit reads it, and so does the result.
    kept = materialize(rows.select(*columns))
    model = kmeans_fit(kept, columns, k, seed)
    clustered = model.transform(kept)
    return model, clustered.withColumn("age_group", age_bins("age_at_admission")) if bin_age else clustered


def kmeans_profiles(
    df: DataFrame,
    flags: Sequence[str] = FLAGS,
    k: int = 3,
    by_gender: bool = True,
    seed: int = 0,
) -> tuple[KMeansFit, DataFrame]:
    """Cluster the mean flag profile of every age group, or age group and gender."""
    keys = ["age_group", *(["gender"] if by_gender else [])]
    # A handful of rows: computed once, then read by every step of the fit.
    profiles = materialize(group_profile(df, keys, flags))
    model = kmeans_fit(profiles, list(flags), k, seed)
    return model, model.transform(profiles)


def cluster_profile(
    clustered: DataFrame, columns: Sequence[str], keys: Sequence[str] = ("age_group", "cluster")
) -> DataFrame:
    """Mean of the clustered columns per age group and cluster."""
    return group_profile(clustered, keys, columns)
