"""Score-by-age reports and the category reports with confidence intervals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardstat.functions.labels import age_bucket
from wardstat.functions.stats import count_where, mean_ci, proportion_ci
from wardstat.functions.temporal import duration_days
from wardstat.operators.cohort import flag_count, included_patients, unique_patients
from wardstat.sources.tables import ClinicalTables

# The age reports have no upper age limit, so ages above the last band form a NULL row.


def _by_age(rows: DataFrame, value: Column, name: str) -> DataFrame:
    return rows.groupBy(age_bucket("age_at_admission").alias("age_bucket")).agg(
        F.count(F.lit(1)).alias("number_of_patients"), F.avg(value).alias(name)
    )


def los_icu_by_age(tables: ClinicalTables) -> DataFrame:
    return _by_age(unique_patients(tables), duration_days("intime", "outtime"), "los_score")


def los_hospital_by_age(tables: ClinicalTables) -> DataFrame:
    times = tables.admissions.select("subject_id", "hadm_id", "admittime", "dischtime")
    rows = unique_patients(tables).join(times, ["subject_id", "hadm_id"])
    return _by_age(rows, duration_days("admittime", "dischtime"), "los_score")


def score_by_age(tables: ClinicalTables) -> DataFrame:
    scores = tables.sofa.select("subject_id", "icustay_id", "sofa")
    rows = unique_patients(tables).join(scores, ["subject_id", "icustay_id"])
    return _by_age(rows, F.col("sofa"), "sofa_score")


def category_cohort(tables: ClinicalTables) -> DataFrame:
    """Adults without an upper age limit, admission matched on subject and admission."""
    cohort = included_patients(tables, min_age=16, max_age=None, keys=("subject_id", "hadm_id"))
    return cohort.withColumnRenamed("admission_type", "admission_category")


def multimorbidity_by_category(tables: ClinicalTables, ci_scale: float = 1.0) -> DataFrame:
    """Share of subjects with more than one condition.

    ``ci_scale=1`` keeps the half width on the 0-1 scale next to a percentage, as the original
    report does; 100 gives a consistent interval.
    """
    counts = tables.elixhauser_quan.select("hadm_id", flag_count().alias("disease_count"))
    rows = category_cohort(tables).select("hadm_id", "admission_category").join(counts, "hadm_id")
    n, hits = F.count(F.lit(1)), count_where(F.col("disease_count") > 1)
    percent = proportion_ci(hits, n, ci_scale=ci_scale)
    return (
        rows.groupBy("admission_category")
        .agg(
            hits.alias("multimorbid_patients"),
            n.alias("total_patients"),
            percent.estimate.alias("percent_multimorbidity"),
            percent.lower.alias("lower_95ci"),
            percent.upper.alias("upper_95ci"),
        )
        .orderBy("admission_category")
    )


def severity_by_category(tables: ClinicalTables) -> DataFrame:
    """Score and both stay lengths.

    A score row meets every cohort row of the same subject and admission, so subjects with tied
    first stays count once per pair of stays.
    """
    cohort = category_cohort(tables)
    scored = cohort.select("subject_id", "hadm_id", "icustay_id", "admission_category").join(
        tables.sofa.select("subject_id", "icustay_id", "sofa"), ["subject_id", "icustay_id"]
    )
    stays = cohort.select(
        "subject_id",
        "hadm_id",
        duration_days("icu_intime", "icu_outtime").alias("los_icu"),
        duration_days("admittime", "dischtime").alias("los_hospital"),
    )
    rows = scored.join(stays, ["subject_id", "hadm_id"])
    measures = []
    for name in ("sofa", "los_icu", "los_hospital"):
        mean = mean_ci(name)
        measures += [
            mean.estimate.alias(f"mean_{name}"),
            mean.lower.alias(f"lower_95ci_{name}"),
            mean.upper.alias(f"upper_95ci_{name}"),
        ]
    return rows.groupBy("admission_category").agg(*measures).orderBy("admission_category")


def mortality_by_category(tables: ClinicalTables) -> DataFrame:
    n, deaths = F.count(F.lit(1)), F.count("deathtime")
    percent = proportion_ci(deaths, n)
    return (
        category_cohort(tables)
        .groupBy("admission_category")
        .agg(
            n.alias("total_patients"),
            deaths.alias("deaths"),
            percent.estimate.alias("percent_mortality"),
            percent.lower.alias("lower_95ci"),
            percent.upper.alias("upper_95ci"),
        )
    )
