"""Bind the sales star schema (customer, orders, lineitem) to the clinical tables.

Customers act as patients, orders as admissions and order lines as intensive-care stays. Every
clinical table is an ordinary DataFrame over the parquet files, so pruning and pushdown reach
the scans and the work grows with the data.
"""

from __future__ import annotations

from functools import cache

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wardstat.sources.tables import FLAGS, ClinicalTables


def star_tables(spark: SparkSession, sf_dir: str) -> ClinicalTables:
    @cache
    def load(name: str) -> DataFrame:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")

    def owner() -> DataFrame:
        return load("orders").selectExpr("o_orderkey as hadm_id", "o_custkey as subject_id")

    def scores(keep: str, name: str, score: str) -> DataFrame:
        return _stay_score(load("lineitem").where(keep), owner(), name, score)

    return ClinicalTables(
        patients=lambda: _patients(load("customer")),
        icustays=lambda: _stays(load("lineitem"), owner()),
        admissions=lambda: _admissions(load("orders")),
        elixhauser_quan=lambda: _flags(load("lineitem")),
        sofa=lambda: scores("l_suppkey % 10 <> 0", "sofa", "l_partkey % 25"),
        oasis=lambda: scores("l_suppkey % 10 <> 1", "oasis", "l_suppkey % 61"),
        angus=lambda: _angus(load("lineitem"), owner()),
        diagnoses_icd=lambda: _diagnoses(load("lineitem")),
    )


def _hours(n: Column) -> Column:
    return F.make_dt_interval(F.lit(0), n.cast("int"))


def _patients(customer: DataFrame) -> DataFrame:
    key = F.col("c_custkey")
    born = F.date_add(F.lit("1885-01-01").cast("date"), ((key * 7919) % 38000).cast("int"))
    return customer.select(
        key.alias("subject_id"),
        F.when(key % 2 == 0, F.lit("M")).otherwise(F.lit("F")).alias("gender"),
        born.cast("timestamp_ntz").alias("dob"),
        F.when(F.col("c_acctbal") < 0, F.date_add(born, F.lit(36500)).cast("timestamp_ntz")).alias("dod"),
    )


def _admissions(orders: DataFrame) -> DataFrame:
    discharged = F.col("o_orderdate") + _hours((F.col("o_orderkey") * 13) % 720 + 1)
    return orders.select(
        F.col("o_orderkey").alias("hadm_id"),
        F.col("o_custkey").alias("subject_id"),
        F.col("o_orderdate").alias("admittime"),
        discharged.alias("dischtime"),
        F.when(F.col("o_orderstatus") == "F", discharged).alias("deathtime"),
        F.when(F.col("o_orderpriority") == "5-LOW", F.lit("ELECTIVE"))
        .when(F.col("o_orderpriority") == "1-URGENT", F.lit("URGENT"))
        .otherwise(F.lit("EMERGENCY"))
        .alias("admission_type"),
    )


def _stay_keys() -> list[Column]:
    return [F.col("l_orderkey").alias("hadm_id"), F.col("l_linenumber")]


def _stay_id() -> Column:
    return (F.col("hadm_id") * 10 + F.col("l_linenumber")).alias("icustay_id")


def _stays(lineitem: DataFrame, owner: DataFrame) -> DataFrame:
    # Aggregate before the join: partial sums leave the scan, and a hot order is combined early.
    lines = lineitem.groupBy(*_stay_keys()).agg(
        F.min("l_shipdate").alias("intime"), F.sum("l_quantity").alias("stay_hours")
    )
    return lines.join(owner, "hadm_id").select(
        _stay_id(),
        "hadm_id",
        "subject_id",
        "intime",
        (F.col("intime") + _hours(F.col("stay_hours"))).alias("outtime"),
    )


def _stay_score(lines: DataFrame, owner: DataFrame, name: str, score: str) -> DataFrame:
    scored = lines.groupBy(*_stay_keys()).agg(F.max(F.expr(score)).cast("int").alias(name))
    return scored.join(owner, "hadm_id").select(_stay_id(), "hadm_id", "subject_id", name)


def _flags(lineitem: DataFrame) -> DataFrame:
    # One 64-bit mask per admission travels through the shuffle instead of 30 columns.
    mask = "bit_or(if(l_discount >= 0.03, shiftleft(1L, cast(l_partkey % 30 as int)), 0L))"
    return lineitem.groupBy(F.col("l_orderkey").alias("hadm_id")).agg(
        *[F.expr(f"cast(getbit({mask}, {i}) as int) as {name}") for i, name in enumerate(FLAGS)]
    )


def _angus(lineitem: DataFrame, owner: DataFrame) -> DataFrame:
    part = F.col("l_partkey")
    marks = lineitem.groupBy(F.col("l_orderkey").alias("hadm_id")).agg(
        F.max((part % 7 == 0).cast("int")).alias("organ_dysfunction"),
        F.max(((part % 17 == 0) | (part % 23 == 0)).cast("int")).alias("explicit_sepsis"),
    )
    return marks.join(owner, "hadm_id").select("hadm_id", "subject_id", "organ_dysfunction", "explicit_sepsis")


def _diagnoses(lineitem: DataFrame) -> DataFrame:
    part = F.col("l_partkey")
    return lineitem.select(
        F.col("l_orderkey").alias("hadm_id"),
        F.when(part % 17 == 0, F.lit("99592"))
        .when(part % 23 == 0, F.lit("78552"))
        .otherwise(part.cast("string"))
        .alias("icd9_code"),
    )
