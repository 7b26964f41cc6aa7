"""CSV with a header row as an exchange format between stages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from wardstat.sources.tables import ClinicalTables

# In the files NULL is an unquoted empty field and an empty string a quoted one. On reading, the
# parser hands unquoted empty fields over as the mark below, which keeps the two apart.
_COMMON = {"header": True, "escape": '"'}
_WRITE = {**_COMMON, "nullValue": "", "emptyValue": '""'}
_READ = {**_COMMON, "nullValue": "\x00", "emptyValue": ""}


def write_csv(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Write one CSV file per partition below ``path``."""
    df.write.mode(mode).options(**_WRITE).csv(path)


def read_csv(spark: SparkSession, path: str, schema: T.StructType | str | None = None) -> DataFrame:
    """Read CSV files with a header; without a schema Spark infers the types in an extra pass."""
    reader = spark.read.options(**_READ)
    reader = reader.option("inferSchema", True) if schema is None else reader.schema(schema)
    return reader.csv(path)


def export_tables(tables: ClinicalTables, root: str, names: tuple[str, ...] = ("sofa", "angus", "oasis", "patients")) -> None:
    """Write whole tables as CSV, one folder each."""
    for name in names:
        write_csv(getattr(tables, name), f"{root}/{name}.csv", mode="overwrite")
