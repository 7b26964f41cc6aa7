"""Operators without a single-task sort against brute force, with very uneven groups."""

from __future__ import annotations

import math
import random

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from wardstat.operators import ordered, prevalence, roc, validation


@pytest.fixture(scope="module")
def skewed():
    rng = random.Random(3)
    rows = []
    for i in range(6000):
        group = "hot" if rng.random() < 0.6 else rng.choice(["a", "b", None])
        rows.append((group, rng.choice([None, *range(40)]) if rng.random() < 0.5 else rng.randrange(3), i))
    return rows


def test_running_totals(spark, skewed):
    df = spark.createDataFrame(skewed, "g string, v int, id int").where("v is not null").repartition(7)
    counts = df.groupBy("g", "v").agg(F.count(F.lit(1)).alias("n"))
    got = ordered.running_totals(counts, ["v"], {"n": "upto"}, "g").collect()
    for group in ("hot", "a", "b", None):
        total = 0
        for row in sorted((r for r in got if r.g == group), key=lambda r: r.v):
            total += sum(1 for g, v, _ in skewed if g == group and v == row.v)
            assert row.upto == total


def test_running_totals_over_many_slices_without_group(spark):
    df = spark.range(0, 5000, 1, 11).select(((F.col("id") * 7919) % 5000).alias("v"), F.lit(1).alias("n"))
    got = ordered.running_totals(df, ["v"], {"n": "place"}, descending=True)
    assert got.where("place <> 5000 - v").count() == 0 and got.count() == 5000


def test_exact_quantiles(spark, skewed):
    df = spark.createDataFrame(skewed, "g string, v int, id int")
    got = {r.g: r for r in ordered.exact_quantiles(df, "v", {"p10": 0.1, "p50": 0.5, "p99": 0.99}, "g").collect()}
    for group, row in got.items():
        values = [v for g, v, _ in skewed if g == group and v is not None]
        assert row.n == len(values)
        for name, p in (("p10", 0.1), ("p50", 0.5), ("p99", 0.99)):
            assert row[name] == pytest.approx(np.quantile(values, p))
    whole = ordered.exact_quantiles(df, "v", {"m": 0.5}).first()
    assert whole.m == np.median([v for _, v, _ in skewed if v is not None])


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.floats(-1e6, 1e6), min_size=1, max_size=40))
def test_boxplot_matches_numpy(spark, values):
    df = spark.createDataFrame([("x", v) for v in values], "g string, v double")
    row = ordered.boxplot_summary(df, "g", "v").first()
    q1, q2, q3 = np.quantile(values, [0.25, 0.5, 0.75])
    assert (row.q1, row.median, row.q3) == pytest.approx((q1, q2, q3))
    lo, hi = row.q1 - 1.5 * (row.q3 - row.q1), row.q3 + 1.5 * (row.q3 - row.q1)
    inside = [v for v in values if lo <= v <= hi]
    assert (row.whisker_low, row.whisker_high) == (min(inside), max(inside))
    assert row.outliers == len(values) - len(inside) and row.n == len(values)


def brute_auc(pairs):
    pos = [s for s, y in pairs if y == 1]
    neg = [s for s, y in pairs if y == 0]
    return sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / (len(pos) * len(neg))


def test_auc_and_curve_with_ties(spark):
    rng = random.Random(5)
    pairs = [(rng.randrange(12) / 4, int(rng.random() < 0.4)) for _ in range(300)]
    df = spark.createDataFrame(pairs + [(None, 1), (1.0, None)], "score double, label int")
    counts = roc.score_counts(df)
    row = roc.auc_score(counts).first()
    assert row.auc == pytest.approx(brute_auc(pairs))
    flipped = roc.auc_score(roc.score_counts(df.withColumn("score", -F.col("score")))).first()
    assert row.auc + flipped.auc == pytest.approx(1.0)
    points = sorted((r.fpr, r.tpr) for r in roc.roc_points(counts).collect())
    assert points[-1] == (1.0, 1.0) and len(points) == 12
    xs, ys = [0.0] + [p[0] for p in points], [0.0] + [p[1] for p in points]
    assert np.trapezoid(ys, xs) == pytest.approx(row.auc)


def test_auc_needs_both_labels(spark):
    df = spark.createDataFrame([(0.1, 1), (0.2, 1)], "score double, label int")
    assert roc.auc_score(roc.score_counts(df)).first().auc is None


def test_folds_are_balanced_and_stable(spark):
    df = spark.range(3007).selectExpr("id", "if(id % 10 < 8, 1, 2) as c")
    first = {r.id: r.fold for r in validation.stratified_folds(df, "c", ["id"], 10, cells=16).collect()}
    again = {r.id: r.fold for r in validation.stratified_folds(df.repartition(5), "c", ["id"], 10, cells=16).collect()}
    assert first == again and len(first) == 3007
    for c in (1, 2):
        members = [f for i, f in first.items() if (1 if i % 10 < 8 else 2) == c]
        sizes = [members.count(f) for f in range(10)]
        assert max(sizes) - min(sizes) <= 1


def _fit_plainly(x, y, w):
    """Penalised logistic regression by plain Newton steps, one model at a time."""
    x = np.column_stack([np.ones(len(x)), x])
    ridge = np.diag([0.0] + [1.0] * (x.shape[1] - 1))
    b = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-x @ b))
        b -= np.linalg.solve((x * (w * p * (1 - p))[:, None]).T @ x + ridge, x.T @ (w * (p - y)) + ridge @ b)
    return b


def test_held_out_scores_match_separate_fits(spark):
    rng = np.random.default_rng(11)
    rows = [(i, int(i % 3), float(rng.integers(0, 2)), float(rng.normal()) + (i % 3)) for i in range(600)]
    df = spark.createDataFrame(rows, "id long, c int, a double, b double")
    folded = validation.stratified_folds(df, "c", ["id"], 4)
    counts = validation.out_of_fold_counts(folded, ["a", "b"], "c")
    data = folded.toPandas()
    got = {r.c: r for r in validation.class_auc(counts, "c").collect()}
    for c in (0, 1, 2):
        pairs = []
        for f in range(4):
            train, test = data[data.fold != f], data[data.fold == f]
            b = _fit_plainly(train[["a", "b"]].to_numpy(), (train.c == c).to_numpy(float), np.ones(len(train)))
            score = np.column_stack([np.ones(len(test)), test[["a", "b"]].to_numpy()]) @ b
            pairs += list(zip(np.round(score, 9), (test.c == c).astype(int)))
        assert got[c].auc == pytest.approx(brute_auc(pairs), abs=1e-6)
        assert (got[c].positives, got[c].negatives) == (200, 400)
    curve = validation.class_roc(counts, "c").where("c = 0")
    assert curve.agg(F.max("fpr"), F.max("tpr")).first() == (1.0, 1.0)


def test_percent_within_group(spark):
    df = spark.createDataFrame(
        [(1, "x", "p"), (2, "x", "p"), (3, "x", "q"), (4, "x", None), (5, None, "p"), (None, "x", "q")],
        "id int, g string, h string",
    )
    rows = {(r.id, r.g, r.h): r.percent for r in prevalence.percent_within_group(df, "g", "h", "id").collect()}
    assert len(rows) == 6
    assert rows[(1, "x", "p")] == 50.0 and rows[(3, "x", "q")] == 25.0 == rows[(None, "x", "q")]
    assert rows[(4, "x", None)] is None and rows[(5, None, "p")] is None


def test_value_counts(spark):
    df = spark.createDataFrame([("a",), ("b",), ("b",), (None,), ("c",), ("c",)], "x string")
    rows = [tuple(r) for r in prevalence.value_counts(df, "x", normalize=True).collect()]
    assert rows == [("b", 2, 0.4), ("c", 2, 0.4), ("a", 1, 0.2)]


def test_binary_columns(spark):
    nan = math.nan
    df = spark.createDataFrame(
        [(0, 1, 5, "m", None, 0.0, nan, True), (1, 1, 6, "f", None, 1.0, 2.0, False), (1, None, 7, "m", None, 0.5, 2.0, True)],
        "bin int, one_or_missing int, three int, text string, empty int, real double, nan_pair double, flag boolean",
    )
    assert prevalence.binary_columns(df) == ["bin", "one_or_missing", "nan_pair", "flag"]


def test_top_conditions_tie_goes_to_the_earlier_column(spark):
    df = spark.createDataFrame([(1, 1, 1, 0), (1, 0, 0, 0)], "class_assignment int, b int, a int, c int")
    rows = prevalence.top_conditions_by_group(df, ["b", "a", "c"], k=2).orderBy("rank").collect()
    assert [r.condition for r in rows] == ["b", "a"]


def test_missing_strata_and_nan_values(spark):
    from wardstat.operators.ordered import boxplot_summary
    from wardstat.operators.roc import score_counts

    rows = [(k, None if k % 4 == 0 else k % 3) for k in range(1000)]
    df = spark.createDataFrame(rows, "id long, c int")
    for order_col in (None, "id"):
        folded = validation.stratified_folds(df, "c", ["id"], 10, order_col=order_col).collect()
        assert sorted(r.id for r in folded) == list(range(1000))
        sizes = {}
        for r in folded:
            sizes[r.c, r.fold] = sizes.get((r.c, r.fold), 0) + 1
        for c in (None, 0, 1, 2):
            own = [sizes[c, f] for f in range(10)]
            assert max(own) - min(own) <= 1
    values = spark.createDataFrame([("g", float(v)) for v in (0, 1, 2, 3)] + [("g", float("nan"))], "g string, v double")
    box = boxplot_summary(values, "g", "v").first()
    assert (box.n, box.median, box.outliers) == (4, 1.5, 0)
    assert score_counts(values.withColumn("label", F.lit(1)), "v").count() == 4


def test_tune_keeps_what_the_user_set(spark):
    from wardstat.session import tune

    other = spark.newSession()
    other.conf.set("spark.sql.session.timeZone", "Asia/Tokyo")
    assert tune(other).conf.get("spark.sql.session.timeZone") == "Asia/Tokyo"
