from __future__ import annotations

from wardstat.operators import codes, cohort, subgroups
from wardstat.plans import reports, tableone
from wardstat.sources.csvfiles import export_tables, read_csv, write_csv
from wardstat.sources.tables import FLAGS, SCHEMAS, ClinicalTables, flag_columns


def ids(df, column="icustay_id"):
    return sorted(r[column] for r in df.select(column).collect())


def test_first_event_keeps_ties_and_drops_null_times(ward):
    assert ids(cohort.first_event(ward.icustays)) == [11, 21, 22, 32, 41, 51, 61, 71, 81]


def test_first_event_of_a_subject_with_most_rows(spark):
    """One subject holds nearly all events; its tied first rows all come back."""
    rows = spark.range(20000).selectExpr("if(id % 50 = 0, id, -1) as k", "cast(id div 1000 as int) as t", "id")
    first = cohort.first_event(rows, "k", "t")
    hot = first.where("k = -1")
    assert hot.count() == 980 and hot.where("t <> 0").count() == 0
    assert first.where("k <> -1").count() == 400


def test_unique_patients_has_no_upper_limit_by_default(ward):
    assert ids(cohort.unique_patients(ward)) == [11, 21, 22, 32, 41, 51, 71, 81]
    ages = {r.icustay_id: r.age_at_admission for r in cohort.unique_patients(ward).collect()}
    assert (ages[11], ages[41], ages[51], ages[71]) == (60, 96, 300, 39)
    assert ids(cohort.unique_patients(ward, min_age=None, max_age=15)) == [61]


def test_included_patients(ward):
    included = cohort.included_patients(ward)
    assert ids(included) == [11, 21, 22, 32, 71, 81]
    kinds = {r.icustay_id: r.admission_type for r in included.collect()}
    assert kinds == {11: "Elective", 21: "Non-Elective", 22: "Non-Elective", 32: "Non-Elective", 71: "Non-Elective", 81: "Elective"}


def test_the_two_joins_to_the_admission_agree_when_the_subject_does(ward):
    both = cohort.included_patients(ward, keys=("subject_id", "hadm_id"))
    assert ids(both) == ids(cohort.included_patients(ward))


def test_missing_flag_counts_zero_but_is_no_complete_case(ward):
    counts = {r.icustay_id: r.disease_count for r in cohort.morbidity_counts(ward).collect()}
    assert counts == {11: 2, 21: 1, 22: 1, 32: 9, 71: 2, 81: 0}
    raw = {r.icustay_id: r.obesity for r in cohort.cohort_with_flags(ward).collect()}
    assert raw[71] is None
    assert ids(cohort.flags_with_age(ward), "hadm_id") == [101, 102, 102, 104, 109]
    assert ids(subgroups.lca_prepare(cohort.cohort_with_flags(ward))) == [11, 21, 22, 32, 81]


def test_stay_lengths(ward):
    row = cohort.morbidity_counts(ward).where("icustay_id = 11").first()
    assert (row.los_icu_days, row.los_hospital_days) == (2.0, 10.0)


def test_both_admission_classes_survive_the_recode(ward):
    prepared = subgroups.lca_prepare(cohort.cohort_with_flags(ward))
    codes_seen = {r.icustay_id: (r.admission_type, r.gender) for r in prepared.collect()}
    assert codes_seen == {11: (1, 0), 21: (0, 1), 22: (0, 1), 32: (0, 0), 81: (1, None)}
    assert {v for r in prepared.select(*FLAGS).collect() for v in r} == {1, 2}


def test_sepsis_flags(ward):
    rows = {r.hadm_id: (r.severe_sepsis, r.septic_shock, r.sepsis) for r in codes.sepsis_flags(ward.admissions, ward.diagnoses_icd).collect()}
    assert rows[101] == (1, 0, 1) and rows[102] == (0, 1, 1) and rows[104] == (0, 0, 0)
    assert rows[105] == (None, None, 0)  # no diagnosis at all
    assert rows[109] == (0, 0, 0)  # a diagnosis without a code
    order = [(r.subject_id, r.hadm_id) for r in codes.sepsis_flags(ward.admissions, ward.diagnoses_icd).collect()]
    assert order == sorted(order)


def test_ages_above_the_last_band_form_a_null_row(ward):
    rows = {r.age_bucket: r.number_of_patients for r in reports.los_icu_by_age(ward).collect()}
    assert rows == {"25-44": 2, "45-64": 4, None: 2} or sum(rows.values()) == 8
    assert rows[None] == 2


def test_unscored_stay_drops_out_of_table_one(ward):
    scored = tableone.scored_cohort(ward)
    assert ids(scored) == [11, 21, 22, 32, 81]
    overall = tableone.table_one_overall(scored).first()
    assert (overall.patient_count, overall.patient_percentage) == (5, 100.0)
    assert overall.median_morbidity_count == 1.0 and overall.iqr_morbidity_count == "1 - 2"
    assert overall.percent_mortality == 40.0 and overall.mortality_95ci.startswith("40 (")


def test_single_row_group_has_no_interval(ward):
    rows = {r.disease_category: r for r in tableone.table_one_disease_count(tableone.scored_cohort(ward)).collect()}
    assert list(rows) == sorted(rows)
    assert rows[">7 diseases"].mean_sofa is not None and rows[">7 diseases"].sofa_lower_95ci is None
    assert rows["1 disease"].sofa_lower_95ci is not None


def test_all_cuts_share_one_total(ward):
    stacked = tableone.table_one_all(tableone.scored_cohort(ward)).collect()
    for cut in {r.cut for r in stacked}:
        part = [r for r in stacked if r.cut == cut]
        assert sum(r.patient_count for r in part) == 5
        assert abs(sum(r.patient_percentage for r in part) - 100) < 1e-9


def test_report_widths(ward):
    scored = tableone.scored_cohort(ward)
    widths = [
        len(report(scored).columns)
        for report in (
            tableone.table_one_overall,
            tableone.table_one_gender,
            tableone.table_one_disease_count,
            tableone.table_one_admission,
            tableone.table_one_age_bucket,
        )
    ]
    assert widths == [15, 20, 15, 20, 19]


def test_severity_counts_tied_stays_once_per_pair(ward):
    rows = {r.admission_category: r for r in reports.severity_by_category(ward).collect()}
    # Subject 2 contributes stays 21 and 22 twice each: lengths 2 and 1 day, scores 21 and 22 mod 13.
    scores = [21 % 13, 21 % 13, 22 % 13, 22 % 13, 32 % 13, 51 % 13]
    assert abs(rows["Non-Elective"].mean_sofa - sum(scores) / 6) < 1e-9


def test_outcome_merge_fans_out_over_stay_level_scores(ward):
    sepsis = codes.sepsis_flags(ward.admissions, ward.diagnoses_icd, ordered=False)
    rows = cohort.cohort_with_flags(ward).selectExpr("*", "1 as class_assignment")
    merged = subgroups.outcome_merge(rows, ward, sepsis)
    assert ids(merged) == [11, 21, 21, 22, 22, 32, 81]
    assert {r.subject_id: r.dod_missing for r in merged.collect()} == {1: True, 2: False, 3: True, 8: True}
    assert "Subgroup" in merged.columns


def test_flag_columns_by_exclusion(ward):
    assert flag_columns(cohort.cohort_with_flags(ward)) == FLAGS


def test_csv_keeps_nulls_and_types(spark, ward, tmp_path):
    text = spark.createDataFrame([(1, None, "a,b"), (2, "", 'say "x"')], "id int, a string, b string")
    write_csv(text, str(tmp_path / "text"))
    back = read_csv(spark, str(tmp_path / "text"), text.schema)
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, text.collect()))
    export_tables(ward, str(tmp_path))
    for name in ("sofa", "angus", "oasis", "patients"):
        again = read_csv(spark, str(tmp_path / f"{name}.csv"), SCHEMAS[name])
        assert again.exceptAll(getattr(ward, name)).count() == 0 and again.count() == getattr(ward, name).count()


def test_tables_from_parquet_csv_and_views(spark, ward, tmp_path):
    for name in ClinicalTables.names():
        getattr(ward, name).write.parquet(str(tmp_path / "pq" / name))
        write_csv(getattr(ward, name), str(tmp_path / "csv" / f"{name}.csv"))
    for loaded in (ClinicalTables.from_parquet(spark, str(tmp_path / "pq")), ClinicalTables.from_csv(spark, str(tmp_path / "csv"))):
        assert ids(cohort.included_patients(loaded)) == [11, 21, 22, 32, 71, 81]
    ward.register_views()
    assert spark.sql("select count(*) from icustays").first()[0] == 11


def test_complete_cases_survive_renamed_columns(spark, ward):
    """The optimizer must not blow up when the tested columns are renamed below the test."""
    renamed = ward.elixhauser_quan.toDF("hadm_id", *[f"x{i}" for i in range(30)])
    again = renamed.toDF("hadm_id", *FLAGS)
    assert cohort.complete_cases(again, FLAGS).count() == 9
