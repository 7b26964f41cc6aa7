"""Exact ordered operations that no single task has to sort: running totals, ranks, quantiles."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wardstat.session import materialize, small_side

_SLICE = "_slice"


def running_totals(
    df: DataFrame,
    order: Sequence[str],
    totals: Mapping[str, str],
    group: str | None = None,
    descending: bool = False,
    whole: Mapping[str, str] | None = None,
    following: Mapping[str, str] | None = None,
) -> DataFrame:
    """Add inclusive running sums along ``order`` (within ``group`` if given).

    ``totals`` maps a numeric column to the name of its running sum, ``whole`` maps one to the
    name of its sum over the whole group (or frame), ``following`` maps one to the name of its value
    in the next row along the order (NULL in the last one). The rows are range
    partitioned and written once to the checkpoint folder, so slice numbers stay fixed; each
    slice is summed on its own and shifted by the total of the slices before it. Neither a large
    group nor the whole frame ever meets in one task.
    """
    lead = [group] if group else []
    keys: list[Column] = [F.col(c) for c in lead]
    keys += [F.col(c).desc() if descending else F.col(c).asc() for c in order]
    sliced = materialize(df.repartitionByRange(*keys).withColumn(_SLICE, F.spark_partition_id()))

    whole = dict(whole or {})
    following = dict(following or {})
    ahead = F.struct(*following) if following else None
    # The next row of a slice's last one is the first row of the slice after it.
    first = (F.max_by if descending else F.min_by)(ahead, F.struct(*order)) if following else None
    per_slice = sliced.groupBy(*lead, _SLICE).agg(
        *[F.sum(c).alias(f"_sum_{c}") for c in {**totals, **whole}], *([first.alias("_first")] if following else [])
    )
    # One row per slice and group: bounded by the partition count plus the number of groups.
    every = Window.partitionBy(*lead)
    before = every.orderBy(_SLICE).rowsBetween(Window.unboundedPreceding, -1)
    offsets = per_slice.select(
        *lead,
        _SLICE,
        *[F.coalesce(F.sum(f"_sum_{c}").over(before), F.lit(0)).alias(f"_offset_{c}") for c in totals],
        *[F.sum(f"_sum_{c}").over(every).alias(name) for c, name in whole.items()],
        *([F.lead("_first").over(every.orderBy(_SLICE)).alias("_beyond")] if following else []),
    )
    inside = Window.partitionBy(*lead, _SLICE).orderBy(*keys).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    added = {name: F.sum(c).over(inside) for c, name in totals.items()}
    if following:
        added["_ahead"] = F.lead(ahead).over(Window.partitionBy(*lead, _SLICE).orderBy(*keys))
    summed = sliced.withColumns(added)
    matched = null_safe_join(summed, offsets, [*lead, _SLICE])
    shifted = matched.withColumns({name: F.col(name) + F.col(f"_offset_{c}") for c, name in totals.items()})
    after = F.coalesce("_ahead", "_beyond") if following else None
    return shifted.select(
        *df.columns, *totals.values(), *whole.values(), *[after[c].alias(name) for c, name in following.items()]
    )


def null_safe_join(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Inner join on ``keys`` where NULL meets NULL; the keys are kept from the left side."""
    renamed = right.withColumnsRenamed({k: f"_r_{k}" for k in keys})
    same = [F.col(k).eqNullSafe(F.col(f"_r_{k}")) for k in keys]
    condition = same[0]
    for test in same[1:]:
        condition = condition & test
    return left.join(renamed, condition).drop(*[f"_r_{k}" for k in keys])


def lookup_rows(rows: DataFrame, lookup: DataFrame, keys: Sequence[str], size: str, heavy_keys: int = 1000) -> DataFrame:
    """Inner join of rows with a lookup of one row per key, where NULL meets NULL and no key is too large.

    ``size`` is the lookup's column with the number of rows of each key. Keys with more than one
    ``heavy_keys``-th of all rows, of which there are fewer than ``heavy_keys``, are sent to the rows;
    the others are joined by an ordinary join, in which no key holds more than that part of the rows.
    """
    lookup = small_side(lookup)
    total = lookup.agg(F.sum(size)).first()[0] or 0
    values = [c for c in lookup.columns if c not in keys]

    def half(heavy: bool) -> DataFrame:
        large = F.col(size) * heavy_keys > total
        picked = lookup.where(large if heavy else ~large)
        return picked.select(*[F.col(k).alias(f"_k_{k}") for k in keys], F.struct(*values).alias(f"_{'heavy' if heavy else 'light'}"))

    same = [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in keys]
    known = rows.join(F.broadcast(half(True)), same, "left").drop(*[f"_k_{k}" for k in keys])
    # Rows that are served are dealt by numbers that the light keys do not have.
    salt = F.when(F.col("_heavy").isNull(), 0).otherwise(1 + F.pmod(F.xxhash64(*rows.columns), F.lit(1 << 16)))
    light = half(False).withColumn("_l_salt", F.lit(0).cast("bigint"))
    salted = known.withColumn("_salt", salt.cast("bigint"))
    joined = salted.join(light, [*same, F.col("_salt") == F.col("_l_salt")], "left")
    found = F.coalesce("_heavy", "_light")
    return joined.where(found.isNotNull()).select(*rows.columns, *[found[v].alias(v) for v in values])


def value_histogram(df: DataFrame, value: str, group: str | None = None) -> DataFrame:
    """Distinct values with their row count, without NULL and NaN; all that follows works on values."""
    lead = [group] if group else []
    return df.where(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double"))).groupBy(*lead, value).agg(F.count(F.lit(1)).alias("n"))


def _ranked(df: DataFrame, value: str, group: str | None) -> DataFrame:
    histogram = value_histogram(df, value, group)
    return running_totals(histogram, [value], {"n": "upto"}, group, whole={"n": "size"})


def exact_quantiles(
    df: DataFrame, value: str, probabilities: Mapping[str, float], group: str | None = None
) -> DataFrame:
    """Exact interpolated quantiles, one column per entry of ``probabilities``, plus ``n``.

    Duplicate values collapse first; the rest is two grouped aggregations, so a group may be of
    any size and the values may be continuous.
    """
    return _quantiles_of_ranked(_ranked(df, value, group), value, probabilities, group)


def _quantiles_of_ranked(
    ranked: DataFrame, value: str, probabilities: Mapping[str, float], group: str | None
) -> DataFrame:
    def at_rank(position: Column) -> Column:
        # The value at a zero-based rank is the smallest one whose running count exceeds it.
        return F.min(F.when(F.col("upto") > position, F.col(value).cast("double")))

    columns = []
    for name, p in probabilities.items():
        target = F.lit(float(p)) * (F.col("size") - 1)
        below, above = at_rank(F.floor(target)), at_rank(F.ceil(target))
        weight = F.max(target - F.floor(target))
        columns.append((below + (above - below) * weight).alias(name))
    return ranked.groupBy(*([group] if group else [])).agg(F.max("size").alias("n"), *columns)


def boxplot_summary(df: DataFrame, group: str, value: str, reach: float = 1.5) -> DataFrame:
    """Box-plot numbers per group: quartiles, whisker ends inside ``reach`` box lengths, outliers."""
    ranked = _ranked(df, value, group)
    box = _quantiles_of_ranked(ranked, value, {"q1": 0.25, "median": 0.5, "q3": 0.75}, group)
    # One row per group; sent to the values when small, so a large group is not gathered again.
    fences = small_side(box.select(group, "q1", "median", "q3"))
    v, span = F.col(value), (F.col("q3") - F.col("q1")) * reach
    inside = v.between(F.col("q1") - span, F.col("q3") + span)
    return (
        null_safe_join(ranked, fences, [group])
        .groupBy(group)
        .agg(
            F.max("size").alias("n"),
            F.max("q1").alias("q1"),
            F.max("median").alias("median"),
            F.max("q3").alias("q3"),
            F.min(F.when(inside, v)).cast("double").alias("whisker_low"),
            F.max(F.when(inside, v)).cast("double").alias("whisker_high"),
            F.sum(F.when(inside, 0).otherwise(F.col("n"))).alias("outliers"),
        )
    )


def boxplot_outliers(df: DataFrame, group: str, value: str, reach: float = 1.5) -> DataFrame:
    """The rows of ``df`` whose value lies beyond ``reach`` box lengths from the box of their group.

    Adds the ``fence`` that the value exceeds, on its side of the box. Rows without a value, or with
    NaN, are no outliers; rows without a group are a group of their own.
    """
    box = exact_quantiles(df, value, {"_q1": 0.25, "_q3": 0.75}, group)
    span = (F.col("_q3") - F.col("_q1")) * reach
    fences = box.select(group, (F.col("_q1") - span).alias("_low"), (F.col("_q3") + span).alias("_high"), F.col("n").alias("_size"))
    usable = df.where(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double")))
    met = lookup_rows(usable, fences, [group], "_size")
    fence = F.when(F.col(value) < F.col("_low"), F.col("_low")).when(F.col(value) > F.col("_high"), F.col("_high"))
    return met.select(*df.columns, fence.alias("fence")).where(F.col("fence").isNotNull())
