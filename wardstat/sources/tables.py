"""The clinical tables the operators read, their schemas and loaders."""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

# The 30 comorbidity flags of an admission, in report order.
FLAGS = [
    "congestive_heart_failure",
    "cardiac_arrhythmias",
    "valvular_disease",
    "pulmonary_circulation",
    "peripheral_vascular",
    "hypertension",
    "paralysis",
    "other_neurological",
    "chronic_pulmonary",
    "diabetes_uncomplicated",
    "diabetes_complicated",
    "hypothyroidism",
    "renal_failure",
    "liver_disease",
    "peptic_ulcer",
    "aids",
    "lymphoma",
    "metastatic_cancer",
    "solid_tumor",
    "rheumatoid_arthritis",
    "coagulopathy",
    "obesity",
    "weight_loss",
    "fluid_electrolyte",
    "blood_loss_anemia",
    "deficiency_anemias",
    "alcohol_abuse",
    "drug_abuse",
    "psychoses",
    "depression",
]

# Columns of a cohort frame that are never comorbidity flags.
NOT_FLAGS = [
    "subject_id",
    "hadm_id",
    "icustay_id",
    "deathtime",
    "gender",
    "age_at_admission",
    "admission_type",
    "los_icu_days",
    "los_hospital_days",
    "class_assignment",
    "count_morbidity",
    "percent",
    "dichotomized_class",
    "posterior",
]


def flag_columns(df: DataFrame, exclude: list[str] | None = None) -> list[str]:
    """Every column that is not in the exclusion list."""
    dropped = set(NOT_FLAGS if exclude is None else exclude)
    return [c for c in df.columns if c not in dropped]


def _struct(**cols: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind, True) for name, kind in cols.items()])


_ID, _INT, _TEXT, _TIME = T.LongType(), T.IntegerType(), T.StringType(), T.TimestampNTZType()

SCHEMAS: dict[str, T.StructType] = {
    "patients": _struct(subject_id=_ID, gender=_TEXT, dob=_TIME, dod=_TIME),
    "icustays": _struct(icustay_id=_ID, hadm_id=_ID, subject_id=_ID, intime=_TIME, outtime=_TIME),
    "admissions": _struct(
        hadm_id=_ID, subject_id=_ID, admittime=_TIME, dischtime=_TIME, deathtime=_TIME, admission_type=_TEXT
    ),
    "elixhauser_quan": _struct(hadm_id=_ID, **{f: _INT for f in FLAGS}),
    "sofa": _struct(icustay_id=_ID, hadm_id=_ID, subject_id=_ID, sofa=_INT),
    "oasis": _struct(hadm_id=_ID, subject_id=_ID, oasis=_INT),
    "angus": _struct(hadm_id=_ID, subject_id=_ID, organ_dysfunction=_INT, explicit_sepsis=_INT),
    "diagnoses_icd": _struct(hadm_id=_ID, icd9_code=_TEXT),
}


class ClinicalTables:
    """The clinical tables as attributes; each is opened when a query first asks for it.

    Give every table as a DataFrame or as a function that returns one.
    """

    patients: DataFrame
    icustays: DataFrame
    admissions: DataFrame
    elixhauser_quan: DataFrame
    sofa: DataFrame
    oasis: DataFrame
    angus: DataFrame
    diagnoses_icd: DataFrame

    def __init__(self, **tables: DataFrame | Callable[[], DataFrame]):
        if missing := set(SCHEMAS) - set(tables):
            raise ValueError(f"missing tables: {sorted(missing)}")
        self._sources = tables

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_") or name not in self._sources:
            raise AttributeError(name)
        source = self._sources[name]
        opened = source if isinstance(source, DataFrame) else source()
        setattr(self, name, opened)
        return opened

    @classmethod
    def names(cls) -> list[str]:
        return list(SCHEMAS)

    @classmethod
    def _opened_by(cls, open_table: Callable[[str], DataFrame]) -> ClinicalTables:
        return cls(**{name: partial(open_table, name) for name in cls.names()})

    @classmethod
    def from_catalog(cls, spark: SparkSession, schema: str = "mimiciii") -> ClinicalTables:
        return cls._opened_by(lambda name: spark.table(f"{schema}.{name}"))

    @classmethod
    def from_parquet(cls, spark: SparkSession, root: str) -> ClinicalTables:
        return cls._opened_by(lambda name: spark.read.schema(SCHEMAS[name]).parquet(f"{root}/{name}"))

    @classmethod
    def from_csv(cls, spark: SparkSession, root: str) -> ClinicalTables:
        from wardstat.sources.csvfiles import read_csv

        return cls._opened_by(lambda name: read_csv(spark, f"{root}/{name}.csv", SCHEMAS[name]))

    def register_views(self) -> None:
        """Expose every table to ``spark.sql`` under its own name."""
        for name in self.names():
            getattr(self, name).createOrReplaceTempView(name)
