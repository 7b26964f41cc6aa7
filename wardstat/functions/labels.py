"""Bucketing, recoding and report formatting, as Column expressions."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardstat.functions.temporal import as_column

# The age bands of the reports, closed on both sides, in whole years.
AGE_BANDS = (
    (16, 24, "16-24"),
    (25, 44, "25-44"),
    (45, 64, "45-64"),
    (65, 84, "65-84"),
    (85, 95, "85-95"),
)


def band(value: Column | str, bands: Sequence[tuple[float, float, str]] = AGE_BANDS) -> Column:
    """Label of the closed range that holds ``value``; NULL outside every range."""
    value = as_column(value)
    return F.coalesce(*[F.when(value.between(lo, hi), F.lit(name)) for lo, hi, name in bands])


def cut(value: Column | str, edges: Sequence[float], labels: Sequence[str], right: bool = False) -> Column:
    """Label of the half-open bin that holds ``value``: ``[lo, hi)``, or ``(lo, hi]`` if ``right``."""
    if len(edges) != len(labels) + 1:
        raise ValueError("need one more edge than labels")
    value = as_column(value)

    def inside(lo: float, hi: float) -> Column:
        return (value > lo) & (value <= hi) if right else (value >= lo) & (value < hi)

    return F.coalesce(
        *[F.when(inside(lo, hi), F.lit(name)) for lo, hi, name in zip(edges, edges[1:], labels)]
    )


def age_bucket(age: Column | str) -> Column:
    return band(age, AGE_BANDS)


def age_bins(age: Column | str) -> Column:
    """The same bands written as half-open bins; equal to :func:`age_bucket` on whole years."""
    edges = [lo for lo, _, _ in AGE_BANDS] + [AGE_BANDS[-1][1] + 1]
    return cut(age, edges, [name for _, _, name in AGE_BANDS])


def disease_label(count: Column | str, top: int = 7) -> Column:
    """Report label of a condition count; everything above ``top`` shares one label."""
    count = as_column(count)
    noun = F.when(count == 1, F.lit(" disease")).otherwise(F.lit(" diseases"))
    exact = F.concat(count.cast("string"), noun)
    return F.when(count > top, F.lit(f">{top} diseases")).when(count >= 0, exact)


def topcode(count: Column | str, cap: int = 8) -> Column:
    """Decimal text of a whole number below ``cap``, one shared label from ``cap`` on."""
    count = as_column(count)
    return F.when(count >= cap, F.lit(f">={cap}")).otherwise(count.cast("bigint").cast("string"))


def admission_category(kind: Column | str) -> Column:
    """Two-way admission label; anything not elective, NULL included, is non-elective."""
    return F.when(F.upper(as_column(kind)) == "ELECTIVE", F.lit("Elective")).otherwise(F.lit("Non-Elective"))


def recode(value: Column | str, mapping: Mapping) -> Column:
    """Value lookup in a small dictionary; values without an entry become NULL."""
    value = as_column(value)
    first, *rest = mapping.items()
    chain = reduce(lambda acc, kv: acc.when(value == kv[0], F.lit(kv[1])), rest, F.when(value == first[0], F.lit(first[1])))
    return chain


def cap_at(value: Column | str, limit: float) -> Column:
    """``min(value, limit)`` that keeps NULL as NULL."""
    value = as_column(value)
    return F.when(value > limit, F.lit(float(limit))).otherwise(value.cast("double"))


def strip_name(name: str) -> str:
    """A column name without its first character, as ``V1`` becomes ``1``."""
    return name[1:]


def strip_first(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Rename columns (all by default) to their names without the first character."""
    return df.withColumnsRenamed({c: strip_name(c) for c in (df.columns if columns is None else columns)})


def report_number(value: Column | str, digits: int = 4) -> Column:
    """Plain decimal text rounded to ``digits`` places, without trailing zeros."""
    fixed = F.round(as_column(value).cast("double"), digits).cast(f"decimal(18,{digits})").cast("string")
    return F.rtrim(F.rtrim(fixed, F.lit("0")), F.lit("."))


def report_text(*parts: Column | str) -> Column:
    """Concatenate numbers (Columns) and fixed text (strings), skipping NULL numbers."""
    return F.concat_ws("", *[F.lit(p) if isinstance(p, str) else report_number(p) for p in parts])
