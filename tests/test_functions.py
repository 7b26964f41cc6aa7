from __future__ import annotations

import datetime as dt
import math
import random

import duckdb
import pytest
from pyspark.sql import functions as F

from wardstat.functions.labels import (
    admission_category,
    age_bins,
    age_bucket,
    cap_at,
    cut,
    disease_label,
    recode,
    report_number,
    report_text,
    topcode,
)
from wardstat.functions.stats import mean_ci, proportion_ci, quartiles, share_of_total
from wardstat.functions.temporal import calendar_age, duration_days


def one(spark, *columns):
    return tuple(spark.range(1).select(*columns).first())


def ntz(text):
    return F.lit(text).cast("timestamp_ntz")


@pytest.mark.parametrize(
    "at, born, years",
    [
        ("1993-02-28 12:00:00", "1932-02-29", 60),
        ("1993-03-01 00:00:00", "1932-02-29", 61),
        ("1996-02-29 00:00:00", "1932-02-29", 64),
        ("2000-03-15 11:59:59", "1960-03-15 12:00:00", 39),
        ("2000-03-15 12:00:00", "1960-03-15 12:00:00", 40),
        ("1993-03-01 06:00:00", "1932-02-29 12:00:00", 61),
        ("1990-03-15 12:00:00", "2000-03-15 06:00:00", -9),
        ("1990-03-15 05:00:00", "2000-03-15 06:00:00", -10),
        ("2000-01-01", "2000-01-01", 0),
        ("2000-01-01", "2000-01-02", 0),
        ("1999-01-01", "2000-01-02", -1),
    ],
)
def test_calendar_age(spark, at, born, years):
    assert one(spark, calendar_age(ntz(at), ntz(born))) == (years,)


def test_calendar_age_equals_duckdb(spark):
    rng = random.Random(7)
    start = dt.datetime(1884, 1, 1)
    pairs = [
        (start + dt.timedelta(seconds=rng.randrange(7 * 10**9)), start + dt.timedelta(days=rng.randrange(40000)))
        for _ in range(3000)
    ]
    leap = dt.datetime(1904, 2, 29)
    pairs += [(dt.datetime(y, m, d), leap) for y in range(1905, 1990) for m, d in ((2, 28), (3, 1))]
    ours = spark.createDataFrame(pairs, "at timestamp_ntz, born timestamp_ntz").select(calendar_age("at", "born")).collect()
    con = duckdb.connect()
    theirs = [con.execute("select date_part('year', age(?::timestamp, ?::timestamp))", p).fetchone()[0] for p in pairs]
    assert [r[0] for r in ours] == theirs


def test_null_times(spark):
    null = F.lit(None).cast("timestamp_ntz")
    assert one(spark, calendar_age(null, ntz("2000-01-01")), duration_days(null, ntz("2000-01-01"))) == (None, None)


def test_duration_days(spark):
    assert one(spark, duration_days(ntz("2000-01-01"), ntz("2000-01-02 12:00:00"))) == (1.5,)
    assert one(spark, duration_days(ntz("2000-01-02"), ntz("2000-01-01"))) == (-1.0,)


def test_duration_ignores_daylight_saving(spark):
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        assert one(spark, duration_days(ntz("2021-03-14"), ntz("2021-03-15"))) == (1.0,)
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_age_bands_and_bins_agree_on_whole_years(spark):
    rows = spark.range(0, 130).select(age_bucket("id"), age_bins("id")).collect()
    assert all(a == b for a, b in rows)
    assert [rows[i][0] for i in (15, 16, 24, 25, 95, 96)] == [None, "16-24", "16-24", "25-44", "85-95", None]


def test_cut_sides(spark):
    left = cut(F.lit(2.0), [0, 2, 4], ["a", "b"])
    right = cut(F.lit(2.0), [0, 2, 4], ["a", "b"], right=True)
    assert one(spark, left, right) == ("b", "a")
    with pytest.raises(ValueError):
        cut(F.lit(1), [0, 1], ["a", "b"])


def test_labels(spark):
    labels = [r[0] for r in spark.range(0, 10).select(disease_label("id")).collect()]
    assert labels[:3] + labels[7:] == ["0 diseases", "1 disease", "2 diseases", "7 diseases", ">7 diseases", ">7 diseases"]
    codes = [r[0] for r in spark.range(6, 10).select(topcode("id")).collect()]
    assert codes == ["6", "7", ">=8", ">=8"]
    assert sorted(["1", "7", ">=8"]) == ["1", "7", ">=8"]


def test_admission_category_keeps_elective_in_any_spelling(spark):
    kinds = ["ELECTIVE", "Elective", "URGENT", None]
    df = spark.createDataFrame([(k,) for k in kinds], "k string")
    assert [r[0] for r in df.select(admission_category("k")).collect()] == ["Elective", "Elective", "Non-Elective", "Non-Elective"]


def test_recode_and_cap(spark):
    df = spark.createDataFrame([("M",), ("X",), (None,)], "g string")
    assert [r[0] for r in df.select(recode("g", {"M": 0, "F": 1})).collect()] == [0, None, None]
    assert one(spark, cap_at(F.lit(0.7), 0.5), cap_at(F.lit(0.2), 0.5), cap_at(F.lit(None).cast("double"), 0.5)) == (0.5, 0.2, None)


def test_report_text(spark):
    assert one(spark, report_number(F.lit(2.0)), report_number(F.lit(0.00001)), report_number(F.lit(1234567.89125))) == ("2", "0", "1234567.8913")
    assert one(spark, report_text(F.lit(1.5), " - ", F.lit(None).cast("double"))) == ("1.5 - ",)


def test_intervals(spark):
    df = spark.createDataFrame([(1, 2.0), (1, 4.0), (1, None), (2, 5.0)], "g int, x double")
    ci, wide = mean_ci("x"), mean_ci("x", n=F.count("g"))
    share = proportion_ci(F.count_if(F.col("x") > 3), F.count(F.lit(1)))
    raw = proportion_ci(F.count_if(F.col("x") > 3), F.count(F.lit(1)), ci_scale=1)
    rows = {r.g: r for r in df.groupBy("g").agg(
        ci.estimate.alias("m"), ci.lower.alias("lo"), wide.lower.alias("lo_n"), share.estimate.alias("p"),
        share.upper.alias("hi"), raw.upper.alias("raw")).collect()}
    sd = math.sqrt(2)
    assert rows[1].m == 3.0 and rows[1].lo == pytest.approx(3 - 1.96 * sd / math.sqrt(2))
    assert rows[1].lo_n == pytest.approx(3 - 1.96 * sd / math.sqrt(3))
    half = 1.96 * math.sqrt((1 / 3) * (2 / 3) / 3)
    assert rows[1].p == pytest.approx(100 / 3) and rows[1].hi == pytest.approx(100 / 3 + 100 * half)
    assert rows[1].raw == pytest.approx(100 / 3 + half)
    assert (rows[2].m, rows[2].lo) == (5.0, None)  # one row has no deviation


def test_empty_group_gives_null_not_an_error(spark):
    df = spark.createDataFrame([(None,)], "x double")
    ci = mean_ci("x")
    assert tuple(df.agg(ci.estimate, ci.lower).first()) == (None, None)


def test_quartiles_and_share(spark):
    df = spark.createDataFrame([("a", 1), ("a", 2), ("a", 3), ("a", 4), ("b", 9)], "g string, x int")
    rows = df.groupBy("g").agg(quartiles("x").alias("q"), F.count("x").alias("n")).withColumn("s", share_of_total("n")).collect()
    assert {r.g: (r.q, r.s) for r in rows} == {"a": ([1.75, 2.5, 3.25], 80.0), "b": ([9.0, 9.0, 9.0], 20.0)}
