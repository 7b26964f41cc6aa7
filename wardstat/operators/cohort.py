"""Cohort selection: first event per subject, age windows, condition counts and flags."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardstat.functions.labels import admission_category, age_bucket
from wardstat.functions.temporal import calendar_age, duration_days
from wardstat.sources.tables import FLAGS, ClinicalTables


def first_event(df: DataFrame, key: str = "subject_id", time: str = "intime") -> DataFrame:
    """Rows at the earliest ``time`` of their ``key``. Ties keep every row, NULL times drop out.

    The minimum is combined on the map side and the rows are matched on ``(key, time)``, so a
    key with very many events is spread over its event times rather than sorted in one task.
    """
    return df.join(earliest(df, key, time), [key, time], "left_semi")


def earliest(df: DataFrame, key: str = "subject_id", time: str = "intime") -> DataFrame:
    """The earliest non-NULL ``time`` of every ``key``."""
    return df.where(F.col(time).isNotNull()).groupBy(key).agg(F.min(time).alias(time))


def unique_patients(
    tables: ClinicalTables, min_age: int | None = 16, max_age: int | None = None
) -> DataFrame:
    """First stay of every subject inside the age window, with demographics.

    The age needs the first time and the birth date only, so subjects are selected before the
    stays are joined; the grouped minimum is already partitioned for the join to the subjects.
    """
    stays = tables.icustays.select("subject_id", "hadm_id", "icustay_id", "intime", "outtime")
    people = tables.patients.select("subject_id", "dob", "gender")
    aged = earliest(stays).join(people, "subject_id").withColumn("age_at_admission", calendar_age("intime", "dob"))
    selected = aged.where(age_window("age_at_admission", min_age, max_age))
    return selected.join(stays, ["subject_id", "intime"]).select(
        "subject_id", "dob", "gender", "hadm_id", "icustay_id", "intime", "outtime", "age_at_admission"
    )


def age_window(column: str, min_age: int | None, max_age: int | None) -> Column:
    """Closed range test; a bound of ``None`` is open, and a NULL age never passes a bound."""
    age = F.col(column)
    tests = [age >= min_age] if min_age is not None else []
    tests += [age <= max_age] if max_age is not None else []
    return reduce(and_, tests, F.lit(True))


def included_patients(
    tables: ClinicalTables,
    min_age: int | None = 16,
    max_age: int | None = 95,
    keys: Sequence[str] = ("hadm_id",),
) -> DataFrame:
    """The study cohort: first stay, age window, admission times and two-way admission type.

    ``keys`` joins the admission; ``("subject_id", "hadm_id")`` also requires the same subject.
    """
    keys = list(keys)
    admissions = tables.admissions.select(*keys, "admittime", "dischtime", "deathtime", "admission_type")
    first = unique_patients(tables, min_age, max_age).drop("dob")
    return first.join(admissions, keys).select(
        "subject_id",
        "hadm_id",
        "icustay_id",
        "deathtime",
        F.col("intime").alias("icu_intime"),
        F.col("outtime").alias("icu_outtime"),
        "admittime",
        "dischtime",
        "gender",
        "age_at_admission",
        admission_category("admission_type").alias("admission_type"),
    )


def complete_cases(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rows without a missing value (NULL or NaN) in ``columns``.

    One test per column, unlike ``na.drop``: the tests reach the file scan, and the optimizer
    can follow each of them through renamed columns on its own.
    """
    tests = [f"`{c}` is not null" for c in columns]
    tests += [f"not isnan(`{c}`)" for c, kind in df.dtypes if c in set(columns) and kind in ("double", "float")]
    return df.where(" and ".join(tests))


def flag_count(flags: Sequence[str] = FLAGS, missing_as_zero: bool = True) -> Column:
    """Number of set flags in a row. A missing flag counts 0, or makes the sum NULL."""
    return F.expr(" + ".join(f"coalesce(`{f}`, 0)" if missing_as_zero else f"`{f}`" for f in flags))


_COHORT_COLUMNS = [
    "subject_id",
    "hadm_id",
    "icustay_id",
    "deathtime",
    "gender",
    "age_at_admission",
    "admission_type",
]


def _stay_lengths() -> list[Column]:
    return [
        duration_days("icu_intime", "icu_outtime").alias("los_icu_days"),
        duration_days("admittime", "dischtime").alias("los_hospital_days"),
    ]


def morbidity_counts(
    tables: ClinicalTables, cohort: DataFrame | None = None, flags: Sequence[str] = FLAGS
) -> DataFrame:
    """Cohort with both lengths of stay in days and the number of conditions."""
    cohort = included_patients(tables) if cohort is None else cohort
    # Count next to the scan: one integer per admission crosses the join, not 30 flags.
    counts = tables.elixhauser_quan.select("hadm_id", flag_count(flags).alias("disease_count"))
    return cohort.join(counts, "hadm_id").select(*_COHORT_COLUMNS, *_stay_lengths(), "disease_count")


def cohort_with_flags(
    tables: ClinicalTables, cohort: DataFrame | None = None, flags: Sequence[str] = FLAGS
) -> DataFrame:
    """Cohort with both lengths of stay in days and the raw flags."""
    cohort = included_patients(tables) if cohort is None else cohort
    return cohort.join(tables.elixhauser_quan.select("hadm_id", *flags), "hadm_id").select(
        *_COHORT_COLUMNS, *_stay_lengths(), *flags
    )


def flags_with_age(
    tables: ClinicalTables, max_age: int = 95, flags: Sequence[str] = FLAGS
) -> DataFrame:
    """Complete-case flags with age and gender of every first stay."""
    people = unique_patients(tables, max_age=max_age).select("hadm_id", "age_at_admission", "gender")
    complete = complete_cases(tables.elixhauser_quan.select("hadm_id", *flags), flags)
    return complete.join(people, "hadm_id")


def flags_with_age_group(
    tables: ClinicalTables, max_age: int = 95, flags: Sequence[str] = FLAGS
) -> DataFrame:
    """As :func:`flags_with_age` with the age band in place of the age."""
    return flags_with_age(tables, max_age, flags).select(
        "hadm_id", *flags, age_bucket("age_at_admission").alias("age_group"), "gender"
    )
