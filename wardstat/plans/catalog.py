"""Every operator and report as a named query over a directory of star-schema parquet files."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wardstat.functions.labels import age_bins, age_bucket, disease_label, recode, strip_first, strip_name, topcode
from wardstat.functions.temporal import calendar_age, duration_days
from wardstat.operators import cluster, codes, cohort, emstep, factors, kmeans, latent, logit, network, ordered
from wardstat.operators import prevalence, roc, subgroups, validation
from wardstat.plans import reports, tableone
from wardstat.session import materialize, scratch_path, tune
from wardstat.sources.csvfiles import export_tables, read_csv, write_csv
from wardstat.sources.positional import ROW, align_by_position, numbered_csv, write_csv_file
from wardstat.sources.star import star_tables
from wardstat.sources.tables import FLAGS, SCHEMAS, ClinicalTables

Query = Callable[[SparkSession, str], DataFrame]

N_CLASSES = 7
# Classes of the fixed parameter table, and how many of them the chain from model to outcomes keeps.
TABLE_CLASSES, TABLE_KEPT = 3, 2
IDS = ["subject_id", "hadm_id", "icustay_id"]
FACTORS = ["admission_type", "gender", "age_at_admission"]


def tidy(df: DataFrame) -> DataFrame:
    """Round doubles to six places for reporting."""
    return df.select(*[F.round(c, 6).alias(c) if kind == "double" else F.col(c) for c, kind in df.dtypes])


def _on_tables(build: Callable[[ClinicalTables], DataFrame]) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return tidy(build(star_tables(tune(spark), sf_dir)))

    return run


# ---- frames that several queries start from ----------------------------------------------


def with_class(df: DataFrame) -> DataFrame:
    """A class number derived from the subject, standing in for a fitted class."""
    return df.withColumn("class_assignment", (F.col("subject_id") % N_CLASSES + 1).cast("int"))


def with_posterior(df: DataFrame) -> DataFrame:
    """One value per class derived from the ids, standing in for class probabilities."""
    spread = [
        ((F.col("subject_id") * 31 + F.col("hadm_id") * 17 + c * c * 37) % 1009).cast("double") / 1009.0
        for c in range(1, N_CLASSES + 1)
    ]
    return with_class(df).withColumn("posterior", F.array(*spread))


def model_rows(t: ClinicalTables) -> DataFrame:
    return subgroups.lca_prepare(cohort.cohort_with_flags(t))


def classed_flags(t: ClinicalTables) -> DataFrame:
    return with_class(cohort.cohort_with_flags(t))


def subgroup_rows(t: ClinicalTables) -> DataFrame:
    reassigned = subgroups.reassign_classes(with_posterior(model_rows(t)))
    return subgroups.subgroup_table(reassigned).drop("posterior")


def outcome_rows(t: ClinicalTables) -> DataFrame:
    sepsis = codes.sepsis_flags(t.admissions, t.diagnoses_icd, ordered=False)
    return subgroups.outcome_merge(classed_flags(t), t, sepsis)


def quality_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Document length as a score for the quality label."""
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.col("n_chars").alias("score"))
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", F.col("quality").alias("label"))
    return roc.score_counts(documents.join(labels, "doc_id"))


# ---- scalar functions ---------------------------------------------------------------------


def _ages(t: ClinicalTables) -> DataFrame:
    stays = t.icustays.join(t.patients.select("subject_id", "dob"), "subject_id")
    return stays.select("subject_id", "icustay_id", calendar_age("intime", "dob").alias("age_at_admission"))


def _buckets(t: ClinicalTables) -> DataFrame:
    age = F.col("age_at_admission")
    return _ages(t).select("icustay_id", "age_at_admission", age_bucket(age).alias("age_bucket"), age_bins(age).alias("age_bin"))


def _recoded(t: ClinicalTables) -> DataFrame:
    return t.patients.join(t.admissions, "subject_id").select(
        "subject_id",
        "hadm_id",
        recode("gender", {"M": 0, "F": 1}).alias("gender_code"),
        recode("admission_type", {"ELECTIVE": 1, "URGENT": 2}).alias("admission_code"),
    )


def _percent(t: ClinicalTables) -> DataFrame:
    rows = cohort.morbidity_counts(t).withColumn("disease_category", disease_label("disease_count"))
    rows = rows.select(*IDS, "gender", "disease_category")
    return prevalence.percent_within_group(rows, "gender", "disease_category", "subject_id")


def _relabelled(t: ClinicalTables) -> DataFrame:
    sparse = cohort.unique_patients(t).select("subject_id", "icustay_id", ((F.col("subject_id") % 5) * 10 + 3).alias("label"))
    return prevalence.relabel_sequential(sparse, "label")


# ---- models -------------------------------------------------------------------------------


def _lca_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = latent.lca_fit(model_rows(star_tables(tune(spark), sf_dir)), N_CLASSES)
    return tidy(model.parameters(spark))


def _lca_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = model_rows(star_tables(tune(spark), sf_dir))
    return tidy(latent.lca_select(rows, range(2, 5)).metrics(spark))


def _lca_posterior(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = materialize(model_rows(star_tables(tune(spark), sf_dir)))
    model = latent.lca_fit(rows, N_CLASSES)
    return model.transform(rows).select(*IDS, "posterior", "class_assignment")


def _class_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validation.class_scores(with_class(model_rows(star_tables(tune(spark), sf_dir))), latent.MANIFEST)


def _fold_sizes(t: ClinicalTables) -> DataFrame:
    folded = validation.stratified_folds(with_class(cohort.included_patients(t)), "class_assignment", IDS)
    return folded.groupBy("class_assignment", "fold").agg(F.count(F.lit(1)).alias("n"))


def _cluster_profile(t: ClinicalTables) -> DataFrame:
    _, clustered = cluster.kmeans_rows(cohort.flags_with_age(t), bin_age=True)
    return cluster.cluster_profile(clustered, [*FLAGS, "age_at_admission"])


def fixed_parameters(rows: DataFrame, classes: int = TABLE_CLASSES) -> DataFrame:
    """A parameter table over the levels of ``rows``, with class probabilities by a plain rule."""
    levels = factors.factor_levels(rows, latent.MANIFEST)
    place = F.array_position(F.lit(latent.MANIFEST), F.col("variable"))
    weight = (1 + (F.col("class") * 7 + place * 3 + F.col("code") * 5) % 11).cast("double")
    spread = levels.withColumn("class", F.explode(F.sequence(F.lit(1), F.lit(classes)))).withColumn("_weight", weight)
    prob = F.col("_weight") / F.sum("_weight").over(Window.partitionBy("variable", "class"))
    share = F.col("class") / F.lit(float(sum(range(1, classes + 1))))
    return spread.select("class", share.alias("share"), "variable", "level", prob.alias("prob"))


def _em_step(t: ClinicalTables) -> DataFrame:
    rows = materialize(model_rows(t).select(*latent.MANIFEST))
    return emstep.lca_em_step(rows, materialize(fixed_parameters(rows)))


def _fixed_criteria(t: ClinicalTables) -> DataFrame:
    """Models of two to four classes by a plain rule, compared by their criteria."""
    rows = materialize(model_rows(t).select(*latent.MANIFEST))
    tables = [materialize(fixed_parameters(rows, k)) for k in (2, 3, 4)]
    return latent.compare_parameters(rows, tables).metrics(rows.sparkSession)


def _fixed_posterior(t: ClinicalTables) -> DataFrame:
    rows = materialize(model_rows(t))
    model = latent.LatentClassModel.from_parameters(fixed_parameters(rows))
    scored = model.transform(rows)
    return scored.select(*IDS, *[F.get("posterior", F.lit(c)).alias(f"p{c + 1}") for c in range(TABLE_CLASSES)], "class_assignment")


def model_classes(t: ClinicalTables) -> DataFrame:
    """Rows classed by a model that one step has fitted, and moved to its most frequent classes."""
    rows = materialize(model_rows(t))
    fitted = emstep.lca_em_step(rows, materialize(fixed_parameters(rows)))
    model = latent.LatentClassModel.from_parameters(fitted)
    scored = materialize(model.transform(rows).where("class_assignment is not null"))
    return subgroups.reassign_classes(scored, k=TABLE_KEPT).drop("posterior")


def _model_outcomes(t: ClinicalTables) -> DataFrame:
    """From the model's classes over the subgroup table to the prevalence of outcomes."""
    table = subgroups.subgroup_table(model_classes(t))
    sepsis = codes.sepsis_flags(t.admissions, t.diagnoses_icd, ordered=False)
    merged = subgroups.outcome_merge(table, t, sepsis)
    marked = merged.withColumn("dod_missing", F.col("dod_missing").cast("int"))
    return prevalence.prevalence_by_group(marked, ["organ_dysfunction", "explicit_sepsis", "sepsis", "dod_missing", *FLAGS], "Subgroup")


def fixed_centers(k: int = 6) -> np.ndarray:
    """Centres over the flags and age, by a plain rule."""
    return np.array([[((i + c) % 5) / 10 for i in range(len(FLAGS))] + [20.0 + 12 * c] for c in range(k)])


# The variables of the fixed logistic models; age in hundreds of years.
LOGIT_FEATURES = ["gender", "admission_type", "age", *FLAGS[:9]]


def logit_weights() -> dict[int, list[float]]:
    return {c: [((c * 5 + j * 3) % 7 - 3) / 20 for j in range(len(LOGIT_FEATURES) + 1)] for c in range(1, N_CLASSES + 1)}


def _logit_gradient(t: ClinicalTables) -> DataFrame:
    rows = with_class(model_rows(t)).withColumns(
        {"age": F.col("age_at_admission") / F.lit(100.0), "fold": (F.col("subject_id") % 10).cast("int")}
    )
    return logit.logit_sums(rows, LOGIT_FEATURES, logit_weights())


def _fixed_scores(t: ClinicalTables) -> DataFrame:
    """Every class's rows scored by whole-number weights, so that equal scores tie exactly."""
    weights = {c: [float((c * 5 + j * 3) % 7 - 3) for j in range(len(LOGIT_FEATURES) + 1)] for c in range(1, N_CLASSES + 1)}
    rows = with_class(model_rows(t)).withColumn("age", F.floor(F.col("age_at_admission") / 10))
    return materialize(logit.class_counts(rows, LOGIT_FEATURES, weights))


def _fixed_clusters(t: ClinicalTables) -> DataFrame:
    """Mean profile of each age group and nearest fixed centre."""
    features = [*FLAGS, "age_at_admission"]
    rows = cohort.flags_with_age(t).withColumn("cluster", kmeans.nearest_center(features, fixed_centers()))
    return cluster.cluster_profile(rows.withColumn("age_group", age_bins("age_at_admission")), features)


def _ordered_folds(t: ClinicalTables) -> DataFrame:
    rows = materialize(with_class(cohort.included_patients(t)).select(*IDS, "class_assignment"))
    folded = validation.ordered_folds(rows, "class_assignment", IDS)
    return validation.target_folds(folded, "class_assignment", IDS)


# ---- sources ------------------------------------------------------------------------------


def _csv_indexed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One ordered file with an index column, read back."""
    rows = cohort.cohort_with_flags(star_tables(tune(spark), sf_dir))
    path = scratch_path(spark, "cohort-indexed") + ".csv"
    write_csv_file(rows, path, IDS, index="row_index")
    return tidy(read_csv(spark, path, "row_index long, " + ", ".join(f"`{c}` {kind}" for c, kind in rows.dtypes)))


def _posterior_aligned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows and class probabilities from two files without a common key, matched by position."""
    rows = materialize(with_posterior(model_rows(star_tables(tune(spark), sf_dir))).select(*IDS, "class_assignment", "posterior"))
    path = scratch_path(spark, "posterior")
    probabilities = [F.get("posterior", F.lit(c)).alias(f"V{c + 1}") for c in range(N_CLASSES)]
    ids, names = [f"_{c}" for c in IDS], [f"V{c + 1}" for c in range(N_CLASSES)]
    write_csv_file(rows.drop("posterior"), f"{path}-rows.csv", IDS)
    # The ids only order the second file: they are read past.
    size = write_csv_file(rows.select(*probabilities, *[F.col(c).alias(k) for c, k in zip(IDS, ids)]), f"{path}-classes.csv", ids)
    # Some sixteen splits, whatever the size.
    cut = max(4096, min(size // 16, 128 << 20))
    left = numbered_csv(spark, f"{path}-rows.csv", "subject_id long, hadm_id long, icustay_id long, class_assignment int", split_bytes=cut)
    right = numbered_csv(spark, f"{path}-classes.csv", ", ".join([f"{n} double" for n in names] + [f"{k} long" for k in ids]), split_bytes=cut)
    aligned = align_by_position(left, strip_first(right.drop(*ids), names)).drop(ROW)
    numbers = [strip_name(n) for n in names]
    moved = subgroups.reassign_classes(aligned.withColumn("posterior", F.array(*[F.col(f"`{n}`") for n in numbers])))
    return tidy(moved.select(*IDS, *[F.col(f"`{n}`").alias(f"p{n}") for n in numbers], "class_assignment"))


def _csv_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = cohort.cohort_with_flags(star_tables(tune(spark), sf_dir))
    path = scratch_path(spark, "cohort-csv")
    write_csv(rows, path)
    return tidy(read_csv(spark, path, rows.schema))


EXPORTED = ("sofa", "angus", "oasis", "patients")


def _exported(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole tables exported and read back, one line each."""
    root = scratch_path(spark, "export")
    tables = star_tables(tune(spark), sf_dir)
    export_tables(tables, root, EXPORTED)
    lines = []
    for name in EXPORTED:
        back = read_csv(spark, f"{root}/{name}.csv", getattr(tables, name).schema)
        filled = sum(F.count(c) for c in SCHEMAS[name].names)
        lines.append(back.agg(F.lit(name).alias("table_name"), F.count(F.lit(1)).alias("n"), F.sum("subject_id").alias("subject_sum"), filled.alias("filled")))
    return lines[0].unionByName(lines[1]).unionByName(lines[2]).unionByName(lines[3])


def _from_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A cohort kept as a named view, and SQL on that name."""
    cohort.included_patients(star_tables(tune(spark), sf_dir)).createOrReplaceTempView("included_patients")
    return tidy(spark.sql(
        "SELECT admission_type, count(*) AS n, avg(age_at_admission) AS mean_age, count(deathtime) AS deaths "
        "FROM included_patients GROUP BY admission_type"
    ))


def _head(t: ClinicalTables) -> DataFrame:
    """The first rows of the cohort by its ids."""
    return cohort.cohort_with_flags(t).orderBy(*IDS).limit(5)


def _targets(t: ClinicalTables) -> DataFrame:
    """One column per class that is 1 for its rows, and gender as a number."""
    rows = with_class(cohort.included_patients(t))
    classes = range(1, N_CLASSES + 1)
    return rows.select(
        *IDS, cluster.male("gender").alias("male"), *[validation.one_vs_all("class_assignment", c).alias(f"target_{c}") for c in classes]
    )


def _answer_patterns(t: ClinicalTables) -> DataFrame:
    """Distinct answers of the complete rows with their number, as the class model reads them."""
    rows = model_rows(t).withColumn("obesity", F.when(F.col("subject_id") % 3 > 0, F.col("obesity")))
    return emstep.answer_patterns(rows, ["admission_type", "gender", "obesity", "hypertension", "depression"])


def _boxplot(t: ClinicalTables) -> DataFrame:
    return ordered.boxplot_summary(cohort.included_patients(t).withColumn(
        "los_hospital_days", duration_days("admittime", "dischtime")
    ), "admission_type", "los_hospital_days")


def _box_scores(t: ClinicalTables) -> DataFrame:
    return ordered.boxplot_summary(outcome_rows(t), "Subgroup", "sofa")


def _box_outliers(t: ClinicalTables) -> DataFrame:
    rows = materialize(cohort.morbidity_counts(t).select(*IDS, "gender", "disease_count"))
    return ordered.boxplot_outliers(rows, "gender", "disease_count")


def _pairs(t: ClinicalTables, by: str | None = None) -> DataFrame:
    return network.cooccurrence(classed_flags(t), FLAGS, by)


def _table_one(report: Callable[[DataFrame], DataFrame]) -> Query:
    return _on_tables(lambda t: report(tableone.scored_cohort(t)))


def queries() -> dict[str, Query]:
    on = _on_tables
    return {
        # selection
        "first_event": on(lambda t: cohort.first_event(t.icustays)),
        "cohort_unique": on(cohort.unique_patients),
        "cohort_included": on(cohort.included_patients),
        "morbidity_counts": on(cohort.morbidity_counts),
        "cohort_with_flags": on(cohort.cohort_with_flags),
        "flags_with_age": on(cohort.flags_with_age),
        "flags_with_age_group": on(cohort.flags_with_age_group),
        "sepsis_flags": on(lambda t: codes.sepsis_flags(t.admissions, t.diagnoses_icd)),
        "csv_roundtrip": _csv_roundtrip,
        "csv_indexed": _csv_indexed,
        "export_tables": _exported,
        "named_view": _from_view,
        "head": on(_head),
        "posterior_aligned": _posterior_aligned,
        # scalar functions
        "calendar_age": on(_ages),
        "duration_days": on(lambda t: t.icustays.select("icustay_id", duration_days("intime", "outtime").alias("los_icu_days"))),
        "age_bucket": on(_buckets),
        "flag_count": on(lambda t: t.elixhauser_quan.select("hadm_id", cohort.flag_count().alias("disease_count"))),
        "morbidity_topcode": on(
            lambda t: cohort.morbidity_counts(t).select(*IDS, topcode("disease_count").alias("count_morbidity"))
        ),
        "recode": on(_recoded),
        "relabel_sequential": on(_relabelled),
        "factor_levels": on(lambda t: factors.factor_levels(cohort.included_patients(t), FACTORS)),
        "factor_conversion": on(lambda t: factors.to_factors(cohort.included_patients(t).select(*IDS, *FACTORS), FACTORS)),
        # reports
        "table_one_overall": _table_one(tableone.table_one_overall),
        "table_one_gender": _table_one(tableone.table_one_gender),
        "table_one_disease_count": _table_one(tableone.table_one_disease_count),
        "table_one_admission": _table_one(tableone.table_one_admission),
        "table_one_age_bucket": _table_one(tableone.table_one_age_bucket),
        "table_one_all": _table_one(tableone.table_one_all),
        "los_hospital_by_age": on(reports.los_hospital_by_age),
        "los_icu_by_age": on(reports.los_icu_by_age),
        "score_by_age": on(reports.score_by_age),
        "multimorbidity_by_category": on(reports.multimorbidity_by_category),
        "severity_by_category": on(reports.severity_by_category),
        "mortality_by_category": on(reports.mortality_by_category),
        # frequencies and prevalence
        "morbidity_distribution": on(lambda t: prevalence.morbidity_distribution(cohort.cohort_with_flags(t))),
        "class_distribution": on(lambda t: subgroups.class_distribution(with_class(cohort.included_patients(t)))),
        "group_profile": on(
            lambda t: prevalence.group_profile(cohort.flags_with_age_group(t), ["age_group", "gender"], FLAGS)
        ),
        "prevalence_overall": on(lambda t: prevalence.prevalence_overall(cohort.cohort_with_flags(t))),
        "prevalence_by_group": on(lambda t: prevalence.prevalence_by_group(classed_flags(t))),
        "prevalence_capped": on(lambda t: prevalence.prevalence_capped(classed_flags(t), cap=0.14)),
        "prevalence_overall_capped": on(lambda t: prevalence.prevalence_capped(cohort.cohort_with_flags(t), group=None)),
        "prevalence_by_age_group": on(lambda t: prevalence.prevalence_by_age_group(cohort.flags_with_age_group(t))),
        "percent_within_group": on(_percent),
        "binary_columns": _binary_columns,
        "top_conditions_by_group": on(lambda t: prevalence.top_conditions_by_group(classed_flags(t))),
        "boxplot_summary": on(_boxplot),
        "boxplot_scores": on(_box_scores),
        "boxplot_oasis": on(lambda t: ordered.boxplot_summary(outcome_rows(t), "Subgroup", "oasis")),
        "boxplot_age": on(lambda t: ordered.boxplot_summary(with_class(cohort.included_patients(t)), "class_assignment", "age_at_admission")),
        "boxplot_outliers": on(_box_outliers),
        "bubble_points": on(
            lambda t: prevalence.bubble_points(
                with_class(cohort.morbidity_counts(t)).withColumn("count_morbidity", topcode("disease_count"))
            )
        ),
        # network
        "cooccurrence": on(_pairs),
        "cooccurrence_by_class": on(lambda t: _pairs(t, "class_assignment")),
        "network_edges": on(lambda t: network.network_edges(_pairs(t))),
        "network_nodes": on(lambda t: network.network_nodes(_pairs(t))),
        "network_edges_by_class": on(lambda t: network.network_edges(_pairs(t, "class_assignment"), "class_assignment")),
        "network_nodes_by_class": on(lambda t: network.network_nodes(_pairs(t, "class_assignment"), "class_assignment")),
        # subgroups
        "lca_prepare": on(model_rows),
        "reassign_classes": on(
            lambda t: subgroups.reassign_classes(with_posterior(model_rows(t))).select(*IDS, "class_assignment")
        ),
        "subgroup_table": on(subgroup_rows),
        "outcome_merge": on(outcome_rows),
        "outcome_prevalence": on(
            lambda t: prevalence.prevalence_by_group(outcome_rows(t), ["organ_dysfunction", "sepsis"], "Subgroup")
        ),
        "outcome_merge_deduped": on(
            lambda t: subgroups.outcome_merge(classed_flags(t), t, codes.sepsis_flags(t.admissions, t.diagnoses_icd, ordered=False), dedupe=True)
        ),
        "stratified_folds": on(_fold_sizes),
        "ordered_folds": on(_ordered_folds),
        "model_subgroups": on(lambda t: subgroups.subgroup_table(model_classes(t))),
        "model_outcomes": on(_model_outcomes),
        # discrimination
        "auc_score": lambda spark, sf: tidy(roc.auc_score(quality_counts(tune(spark), sf))),
        "roc_points": lambda spark, sf: tidy(roc.roc_points(quality_counts(tune(spark), sf))),
        "roc_points_pruned": lambda spark, sf: tidy(roc.roc_points(quality_counts(tune(spark), sf), prune=True)),
        "logit_gradient": on(_logit_gradient),
        "class_auc": lambda spark, sf: tidy(validation.class_auc(_class_scores(spark, sf))),
        "class_roc": lambda spark, sf: tidy(validation.class_roc(_class_scores(spark, sf))),
        "class_targets": on(_targets),
        # models
        "answer_patterns": on(_answer_patterns),
        "lca_em_step": on(_em_step),
        "lca_criteria_fixed": on(_fixed_criteria),
        "lca_posterior_fixed": on(_fixed_posterior),
        "class_auc_fixed": on(lambda t: roc.auc_score(_fixed_scores(t), "class_assignment")),
        "class_roc_fixed": on(lambda t: roc.roc_points(_fixed_scores(t), "class_assignment", prune=True)),
        "cluster_profile_fixed": on(_fixed_clusters),
        "kmeans_step": on(lambda t: kmeans.lloyd_step(cohort.flags_with_age(t), [*FLAGS, "age_at_admission"], fixed_centers())),
        "lca_fit": _lca_fit,
        "lca_select": _lca_select,
        "lca_posterior": _lca_posterior,
        "kmeans_rows": on(lambda t: cluster.kmeans_rows(cohort.flags_with_age(t))[1]),
        "kmeans_profiles": on(lambda t: cluster.kmeans_profiles(cohort.flags_with_age_group(t))[1]),
        "cluster_profile": on(_cluster_profile),
    }


def _binary_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = materialize(outcome_rows(star_tables(tune(spark), sf_dir)))
    # One row per column of the table, not of the data.
    return spark.createDataFrame([(c,) for c in prevalence.binary_columns(rows)], "column_name string")
