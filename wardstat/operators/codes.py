"""Indicators from coded event lists."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Diagnosis codes of severe sepsis and septic shock.
SEPSIS_CODES = {"severe_sepsis": ["99592"], "septic_shock": ["78552"]}


def code_flags(df: DataFrame, key: str, code: str, names: Mapping[str, Sequence[str]]) -> DataFrame:
    """One row per ``key`` with a 0/1 column per name: does any of its codes occur?"""
    found = [
        F.max(F.when(F.col(code).isin(list(codes)), 1).otherwise(0)).alias(name) for name, codes in names.items()
    ]
    return df.groupBy(key).agg(*found)


def sepsis_flags(admissions: DataFrame, diagnoses: DataFrame, ordered: bool = True) -> DataFrame:
    """Sepsis indicators of every admission.

    The two code columns are NULL for an admission without diagnoses; ``sepsis`` is then 0.
    """
    coded = code_flags(diagnoses, "hadm_id", "icd9_code", SEPSIS_CODES)
    either = (F.col("severe_sepsis") == 1) | (F.col("septic_shock") == 1)
    flagged = admissions.select("subject_id", "hadm_id").join(coded, "hadm_id", "left").select(
        "subject_id",
        "hadm_id",
        "severe_sepsis",
        "septic_shock",
        F.when(either, 1).otherwise(0).alias("sepsis"),
    )
    return flagged.orderBy("subject_id", "hadm_id") if ordered else flagged
