"""From fitted classes to the subgroup table, and joining outcomes to it."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wardstat.functions.labels import recode, topcode
from wardstat.operators.cohort import complete_cases, flag_count
from wardstat.operators.prevalence import part_percentages, value_counts
from wardstat.session import materialize, small_side
from wardstat.sources.tables import FLAGS, ClinicalTables

# Integer codes of the two-level variables in the class model.
GENDER_CODES = {"M": 0, "F": 1}


def lca_prepare(cohort: DataFrame, flags: Sequence[str] = FLAGS) -> DataFrame:
    """Model input: admission and gender as 0/1, complete flags shifted from 0/1 to 1/2.

    Admission labels are compared without regard to case, so elective stays survive whichever
    spelling the cohort carries.
    """
    elective = F.upper(F.col("admission_type")) == "ELECTIVE"
    coded = complete_cases(cohort, flags)
    return coded.withColumns(
        {
            "admission_type": F.coalesce(elective, F.lit(False)).cast("int"),
            "gender": recode("gender", GENDER_CODES),
            **{f: F.expr(f"`{f}` + 1") for f in flags},
        }
    )


def top_classes(df: DataFrame, column: str = "class_assignment", k: int = 6) -> list[int]:
    """The ``k`` most frequent classes; equal frequencies go to the smaller class number."""
    return [row[column] for row in value_counts(df, column).limit(k).collect()]


def reassign_classes(
    df: DataFrame, k: int = 6, posterior: str = "posterior", column: str = "class_assignment"
) -> DataFrame:
    """Move every row to its most probable class among the ``k`` most frequent ones.

    ``posterior`` holds one probability per class, class 1 first. The probabilities are not
    rescaled; equal ones go to the more frequent class.
    """
    keep = top_classes(df, column, k)
    kept = F.array(*[F.get(posterior, F.lit(c - 1)) for c in keep])
    labels = F.array(*[F.lit(c) for c in keep])
    best = F.element_at(labels, F.array_position(kept, F.array_max(kept)).cast("int"))
    return df.withColumn(column, best)


def class_distribution(df: DataFrame, column: str = "class_assignment") -> DataFrame:
    return value_counts(df, column, normalize=True)


def class_lookup(df: DataFrame, group: str, part: str, count_of: str) -> DataFrame:
    """Per (group, part): its percentage of the group and the group's sequential number."""
    return part_percentages(df, group, part, count_of).withColumn(
        "_label", F.dense_rank().over(Window.orderBy(group))
    )


def subgroup_table(
    df: DataFrame,
    flags: Sequence[str] = FLAGS,
    class_map: Mapping[int, int] | None = None,
    shift: int = 1,
    cap: int = 8,
    id_cols: Sequence[str] = ("subject_id", "hadm_id", "icustay_id"),
) -> DataFrame:
    """Flags back on 0/1, top-coded condition count, its percentage in the class, tidy class numbers.

    Rows are sorted by the count and then by those of ``id_cols`` that there are, so that the rows
    of one count spread over many sorting tasks.
    """
    unshifted = df.withColumns({f: F.expr(f"`{f}` - {shift}") for f in flags})
    # Written once: the lookup and the result both read it.
    counted = materialize(unshifted.withColumn("count_morbidity", topcode(flag_count(flags), cap)))
    # Percentages and tidy numbers both come from the (class, count) frequencies: one pass over
    # the rows for the small lookup, one to attach it.
    labels = class_lookup(counted, "class_assignment", "count_morbidity", "subject_id")
    attached = counted.join(small_side(labels), ["class_assignment", "count_morbidity"], "left")
    columns = [F.col("_label").alias(c) if c == "class_assignment" else F.col(c) for c in counted.columns]
    table = attached.select(*columns, "percent")
    if class_map is not None:
        table = table.withColumn("class_assignment", recode("class_assignment", class_map))
    return table.orderBy("count_morbidity", *[c for c in id_cols if c in table.columns])


def outcome_merge(
    subgroups: DataFrame, tables: ClinicalTables, sepsis: DataFrame, dedupe: bool = False
) -> DataFrame:
    """Add scores, organ dysfunction, sepsis and survival to the subgroup rows (inner joins).

    A stay-level score table repeats an admission with several stays, and so does the result. With
    ``dedupe`` every score table keeps the largest score of an admission, and no row is repeated.
    """
    ids = ["subject_id", "hadm_id"]

    def scores(table: DataFrame, *names: str) -> DataFrame:
        picked = table.select(*ids, *names)
        return picked.groupBy(*ids).agg(*[F.max(n).alias(n) for n in names]) if dedupe else picked

    alive = tables.patients.select("subject_id", F.isnull("dod").alias("dod_missing"))
    return (
        subgroups.join(scores(tables.sofa, "sofa"), ids)
        .join(scores(tables.oasis, "oasis"), ids)
        .join(scores(tables.angus, "organ_dysfunction", "explicit_sepsis"), ids)
        .join(scores(sepsis, "sepsis"), ids)
        .join(alive, "subject_id")
        .withColumnRenamed("class_assignment", "Subgroup")
    )
