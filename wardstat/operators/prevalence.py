"""Frequencies, group means and prevalence tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wardstat.functions.labels import cap_at
from wardstat.operators.cohort import flag_count
from wardstat.session import materialize, small_side
from wardstat.sources.tables import FLAGS


def value_counts(df: DataFrame, column: str, normalize: bool = False) -> DataFrame:
    """Frequency of each non-NULL value, most frequent first; ``share`` is added on request."""
    counts = df.where(F.col(column).isNotNull()).groupBy(column).agg(F.count(F.lit(1)).alias("n"))
    if normalize:
        # A scalar subquery over the same counts; Spark reuses their exchange.
        counts = counts.withColumn("share", F.col("n") / counts.agg(F.sum("n")).scalar())
    return counts.orderBy(F.desc("n"), column)


def morbidity_distribution(df: DataFrame, flags: Sequence[str] = FLAGS) -> DataFrame:
    """How many rows have 0, 1, 2, ... conditions; rows with a missing flag are left out."""
    summed = df.select(flag_count(flags, missing_as_zero=False).cast("bigint").alias("morbidity_count"))
    return value_counts(summed, "morbidity_count")


def group_profile(df: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Mean of every column per key combination; rows with a missing key are left out."""
    keys = list(keys)
    return df.na.drop(subset=keys).groupBy(*keys).agg(*[F.expr(f"avg(`{c}`) as `{c}`") for c in columns])


def long_form(df: DataFrame, keys: Sequence[str], columns: Sequence[str], name: str, value: str) -> DataFrame:
    return df.unpivot([F.col(k) for k in keys], [F.col(c) for c in columns], name, value)


def prevalence_overall(df: DataFrame, flags: Sequence[str] = FLAGS) -> DataFrame:
    """Mean of each flag over all rows, as (condition, prevalence)."""
    return long_form(df.agg(*[F.expr(f"avg(`{f}`) as `{f}`") for f in flags]), [], flags, "condition", "prevalence")


def prevalence_by_group(df: DataFrame, conditions: Sequence[str] = FLAGS, group: str = "class_assignment") -> DataFrame:
    """Percentage with each condition per group, one row per group."""
    present = df.where(F.col(group).isNotNull())
    return present.groupBy(group).agg(*[F.expr(f"avg(`{c}`) * 100D as `{c}`") for c in conditions])


def prevalence_capped(
    df: DataFrame, flags: Sequence[str] = FLAGS, group: str | None = "class_assignment", cap: float = 0.5
) -> DataFrame:
    """Mean of each flag per group (or overall), cut off at ``cap``, in long form."""
    means = prevalence_overall(df, flags) if group is None else long_form(
        group_profile(df, [group], flags), [group], flags, "condition", "prevalence"
    )
    return means.withColumn("prevalence", cap_at("prevalence", cap))


def top_conditions_by_group(
    df: DataFrame, flags: Sequence[str] = FLAGS, group: str = "class_assignment", k: int = 6
) -> DataFrame:
    """The ``k`` most prevalent conditions of each group; ties go to the earlier condition."""
    long = long_form(group_profile(df, [group], flags), [group], flags, "condition", "prevalence")
    position = F.array_position(F.array(*[F.lit(f) for f in flags]), F.col("condition"))
    # At most len(flags) rows per group remain at this point.
    best = Window.partitionBy(group).orderBy(F.desc("prevalence"), position)
    return long.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


def binary_columns(df: DataFrame, candidates: Sequence[str] | None = None) -> list[str]:
    """Non-text columns with exactly two distinct values, a missing value counting as one.

    Two plain passes (extremes and missing counts, then a test for anything in between) replace
    one distinct count per column, which would multiply the rows by the number of columns.
    """
    kinds = {f.name: f.dataType for f in df.schema.fields}
    names = [c for c in (candidates or df.columns) if not isinstance(kinds[c], T.StringType)]
    floating = {c for c in names if isinstance(kinds[c], (T.DoubleType, T.FloatType))}
    clean = df.select(*[F.nanvl(c, F.lit(None).cast("double")).alias(c) if c in floating else F.col(c) for c in names])
    edge = clean.agg(
        *[F.expr(f"min(`{c}`) as `lo_{c}`") for c in names],
        *[F.expr(f"max(`{c}`) as `hi_{c}`") for c in names],
        *[F.expr(f"count_if(`{c}` is null) as `missing_{c}`") for c in names],
    ).first()

    def distinct_ends(c: str) -> int:
        if edge[f"lo_{c}"] is None:
            return 0
        return 1 if edge[f"lo_{c}"] == edge[f"hi_{c}"] else 2

    with_missing = {c for c in names if edge[f"missing_{c}"] > 0}
    constant = [c for c in names if c in with_missing and distinct_ends(c) == 1]
    pair = [c for c in names if c not in with_missing and distinct_ends(c) == 2]
    if pair:
        between = clean.agg(
            *[F.count_if((F.col(c) != edge[f"lo_{c}"]) & (F.col(c) != edge[f"hi_{c}"])).alias(c) for c in pair]
        ).first()
        pair = [c for c in pair if between[c] == 0]
    found = set(constant) | set(pair)
    return [c for c in names if c in found]


def prevalence_by_age_group(
    df: DataFrame, age_group: str = "age_group", ignore: Sequence[str] = ("hadm_id", "gender")
) -> DataFrame:
    """Mean of every binary column per age group, in long form."""
    df = materialize(df.drop(*ignore))  # read by the tests for two values and by the means
    columns = [c for c in binary_columns(df) if c != age_group]
    return long_form(group_profile(df, [age_group], columns), [age_group], columns, "condition", "prevalence")


def percent_within_group(df: DataFrame, group: str, part: str, count_of: str, name: str = "percent") -> DataFrame:
    """Add to every row the percentage of its ``group`` that shares its ``part``.

    The counts are grouped once and joined back as a small lookup, so the rows are not shuffled
    by ``group``, where one value may hold a large part of them.
    """
    lookup = small_side(part_percentages(df, group, part, count_of, name))
    return df.join(lookup, [group, part], "left").select(*df.columns, name)


def part_percentages(df: DataFrame, group: str, part: str, count_of: str, name: str = "percent") -> DataFrame:
    """Percentage of each ``part`` in its ``group``, one row per pair without missing values.

    Rows with a missing ``part`` count in the size of their group.
    """
    counts = df.where(F.col(group).isNotNull()).groupBy(group, part).agg(F.count(count_of).alias("_part_n"))
    total = F.sum("_part_n").over(Window.partitionBy(group))
    percent = (F.col("_part_n") / F.nullif(total, F.lit(0)) * 100.0).alias(name)
    return counts.select(group, part, percent).where(F.col(part).isNotNull())


def relabel_sequential(df: DataFrame, column: str) -> DataFrame:
    """Replace the values of ``column`` by 1, 2, ... in ascending order of value."""
    # One row per distinct label.
    rank = F.row_number().over(Window.orderBy(column)).alias("_label")
    labels = df.where(F.col(column).isNotNull()).select(column).distinct().select(column, rank)
    joined = df.join(small_side(labels), column, "left")
    return joined.select(*[F.col("_label").alias(c) if c == column else F.col(c) for c in df.columns])


def bubble_points(df: DataFrame, group: str = "class_assignment", part: str = "count_morbidity") -> DataFrame:
    """Distinct points of the subgroup bubble chart: group, count label, percentage."""
    counts = df.where(F.col(group).isNotNull() & F.col(part).isNotNull()).groupBy(group, part).agg(
        F.count(F.lit(1)).alias("n")
    )
    total = F.sum("n").over(Window.partitionBy(group))
    return counts.withColumn("percent", F.col("n") / total * 100.0)
