"""Table One: grouped descriptive statistics with 95 % confidence intervals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardstat.functions.labels import age_bucket, disease_label, report_text
from wardstat.functions.stats import Interval, count_where, mean_ci, proportion_ci, quartiles, share_of_total
from wardstat.operators.cohort import morbidity_counts
from wardstat.sources.tables import ClinicalTables

# Report name of each mean, and the column it is taken from.
_MEANS = {"sofa": "sofa", "los_icu": "los_icu_days", "los_hospital": "los_hospital_days"}


def scored_cohort(tables: ClinicalTables, morbidity: DataFrame | None = None) -> DataFrame:
    """Cohort rows that have a severity score; stays without a score drop out."""
    morbidity = morbidity_counts(tables) if morbidity is None else morbidity
    return morbidity.join(tables.sofa.select("icustay_id", "sofa"), "icustay_id")


def with_report_labels(scored: DataFrame) -> DataFrame:
    return scored.withColumns(
        {
            "age_bucket": age_bucket("age_at_admission"),
            "disease_category": disease_label("disease_count"),
        }
    )


def _statistics() -> tuple[list[Column], list[str]]:
    """Every statistic of the report as one set of aggregates, with their names."""
    rows = F.count(F.lit(1))
    ids = F.count("subject_id")
    found: dict[str, Column] = {"patient_count": rows, "_quartiles": quartiles("disease_count")}

    def keep(name: str, interval: Interval) -> None:
        found[f"{name}"] = interval.estimate
        found[f"{name}_lo"] = interval.lower
        found[f"{name}_hi"] = interval.upper

    keep("percent_multimorbidity", proportion_ci(count_where(F.col("disease_count") > 1), rows))
    keep("percent_mortality", proportion_ci(F.count("deathtime"), rows))
    keep("mean_sofa", mean_ci("sofa"))
    # The stay lengths divide by the number of subjects, the score by its own count.
    for name in ("los_icu", "los_hospital"):
        keep(f"mean_{name}", mean_ci(_MEANS[name], n=ids))
    return [c.alias(n) for n, c in found.items()], list(found)


def _quartile_columns() -> list[Column]:
    q = F.col("_quartiles")
    return [q[1].alias("median_morbidity_count"), report_text(q[0], " - ", q[2]).alias("iqr_morbidity_count")]


def _bounds(source: str, lower: str, upper: str) -> list[Column]:
    return [F.col(source), F.col(f"{source}_lo").alias(lower), F.col(f"{source}_hi").alias(upper)]


def _as_text(source: str, name: str) -> list[Column]:
    middle = F.col(source)
    text = report_text(middle, " (", F.col(f"{source}_lo"), ", ", F.col(f"{source}_hi"), ")")
    return [middle, text.alias(name)]


def _mean_bounds() -> list[Column]:
    return [c for name in _MEANS for c in _bounds(f"mean_{name}", f"{name}_lower_95ci", f"{name}_upper_95ci")]


_MULTIMORBIDITY = ("percent_multimorbidity", "lower_95ci_multimorbidity", "upper_95ci_multimorbidity")
_MORTALITY = ("percent_mortality", "lower_95ci_mortality", "upper_95ci_mortality")


def _grouped(scored: DataFrame, by: str) -> DataFrame:
    columns, _ = _statistics()
    return scored.groupBy(by).agg(*columns)


def _percentage() -> Column:
    return share_of_total("patient_count").alias("patient_percentage")


def table_one_overall(scored: DataFrame) -> DataFrame:
    """One row for the whole cohort; the intervals are report text."""
    columns, _ = _statistics()
    return scored.agg(*columns).select(
        "patient_count",
        _percentage(),
        *_quartile_columns(),
        *_bounds(*_MULTIMORBIDITY),
        *[c for name in _MEANS for c in _as_text(f"mean_{name}", f"{name}_95ci")],
        *_as_text("percent_mortality", "mortality_95ci"),
    )


def table_one_by(scored: DataFrame, by: str, share: bool = True) -> DataFrame:
    """One row per value of ``by``, ordered by it."""
    return (
        _grouped(scored, by)
        .select(
            by,
            "patient_count",
            *([_percentage()] if share else []),
            *_quartile_columns(),
            *_bounds(*_MULTIMORBIDITY),
            *_mean_bounds(),
            *_bounds(*_MORTALITY),
        )
        .orderBy(by)
    )


def table_one_gender(scored: DataFrame) -> DataFrame:
    return table_one_by(scored, "gender")


def table_one_admission(scored: DataFrame) -> DataFrame:
    return table_one_by(scored, "admission_type")


def table_one_age_bucket(scored: DataFrame) -> DataFrame:
    return table_one_by(with_report_labels(scored), "age_bucket", share=False)


def table_one_disease_count(scored: DataFrame) -> DataFrame:
    """By condition count: no quartiles and no multimorbidity share, which the grouping fixes."""
    by = "disease_category"
    return (
        _grouped(with_report_labels(scored), by)
        .select(
            by,
            "patient_count",
            _percentage(),
            *_mean_bounds(),
            *_bounds("percent_mortality", "mortality_lower_95ci", "mortality_upper_95ci"),
        )
        .orderBy(by)
    )


_CUTS = ["gender", "disease_category", "admission_type", "age_bucket"]


def table_one_all(scored: DataFrame) -> DataFrame:
    """All five cuts from one scan and one exchange, stacked as (cut, label, statistics)."""
    columns, names = _statistics()
    sets = [[]] + [[c] for c in _CUTS]
    grouped = (
        with_report_labels(scored)
        .groupingSets(sets, *_CUTS)
        .agg(*columns, *[F.grouping(c).alias(f"_not_{c}") for c in _CUTS])
    )
    cut = F.coalesce(*[F.when(F.col(f"_not_{c}") == 0, F.lit(c)) for c in _CUTS], F.lit("overall"))
    suffixes = {"_lo": "_lower_95ci", "_hi": "_upper_95ci"}
    numbers = [
        F.col(n).alias(n[:-3] + suffixes[n[-3:]] if n[-3:] in suffixes else n)
        for n in names
        if n not in ("patient_count", "_quartiles")
    ]
    return grouped.withColumn("cut", cut).select(
        "cut",
        F.coalesce(*_CUTS).alias("label"),
        "patient_count",
        share_of_total("patient_count", "cut").alias("patient_percentage"),
        *_quartile_columns(),
        *numbers,
    )
