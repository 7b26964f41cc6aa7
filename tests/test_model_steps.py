"""Factors, EM steps and posteriors from tables, k-means, logistic sums, folds along row order."""

from __future__ import annotations

import warnings

import numpy as np
import pytest
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from wardstat.operators import cohort, emstep, factors, kmeans, latent, logit, ordered, roc, subgroups, validation
from wardstat.plans import catalog
from wardstat.sources.star import star_tables


# ---- factors ------------------------------------------------------------------------------


def test_factor_levels_and_codes(spark):
    rows = [(10, "b", 1.5), (9, "a", None), (10, None, 1.5), (100, "B", -2.0), (None, "", 1e300)]
    df = spark.createDataFrame(rows, "n int, t string, x double")
    got = {(r.variable, r.level): (r.code, r.n) for r in factors.factor_levels(df, ["n", "t", "x"]).collect()}
    assert got == {
        ("n", "9"): (1, 1), ("n", "10"): (2, 2), ("n", "100"): (3, 1),
        ("t", ""): (1, 1), ("t", "B"): (2, 1), ("t", "a"): (3, 1), ("t", "b"): (4, 1),
        ("x", "-2.0"): (1, 1), ("x", "1.5"): (2, 2), ("x", "1.0E300"): (3, 1),
    }
    coded = [tuple(r) for r in factors.to_factors(df, ["n", "t", "x"]).collect()]
    assert coded == [(2, 4, 2), (1, 3, None), (2, None, 2), (3, 2, 1), (None, 1, 3)]


def test_missing_factor_columns_are_warned_about(spark):
    df = spark.createDataFrame([(1,), (2,)], "a int")
    with pytest.warns(UserWarning, match="column nothing not found"):
        out = factors.to_factors(df, ["nothing", "a"])
    assert out.columns == ["a"] and sorted(r.a for r in out.collect()) == [1, 2]
    with warnings.catch_warnings():
        warnings.simplefilter("error")
        factors.to_factors(df, ["a"])
    with pytest.warns(UserWarning):
        assert factors.factor_levels(df, ["nothing"]).count() == 0


def test_too_many_levels_are_refused(spark):
    with pytest.raises(ValueError, match="no factors"):
        factors.level_dictionary(spark.range(50), ["id"], max_levels=20)


def test_unknown_values_and_weights(spark):
    df = spark.createDataFrame([("x", 3), ("y", 4), ("x", 5)], "c string, w int")
    assert [r.c for r in factors.to_factors(df, ["c"], {"c": ["y"]}).collect()] == [None, 1, None]
    assert {r.level: r.n for r in factors.factor_levels(df, ["c"], "w").collect()} == {"x": 8, "y": 4}


# ---- latent classes -----------------------------------------------------------------------


@pytest.fixture(scope="module")
def answers(spark):
    rng = np.random.default_rng(11)
    cls = rng.choice(2, size=3000, p=[0.6, 0.4])
    truth = np.array([[0.9, 0.8, 0.2, 0.7], [0.2, 0.1, 0.9, 0.4]])
    x = (rng.uniform(size=(3000, 4)) < truth[cls]).astype(int)
    rows = [(i, int(c), *map(int, r[:3]), "hi" if r[3] else "lo") for i, (c, r) in enumerate(zip(cls, x))]
    rows += [(9000, 0, None, 1, 1, "hi"), (9001, 0, 0, 1, 1, None)]
    return spark.createDataFrame(rows, "id int, planted int, a int, b int, c int, d string").repartition(6)


VARIABLES = ["a", "b", "c", "d"]


def test_em_steps_from_a_table_follow_the_fit(spark, answers):
    """Steps over tables give the likelihoods and parameters of the steps over arrays."""
    patterns = latent.Patterns(answers, VARIABLES)
    run = latent._random_start(patterns.coding, 2, np.random.default_rng(4))
    shares, probs = run.shares, run.probs
    model = latent.LatentClassModel(patterns.coding, shares, probs, 0.0, 0, 0, False)
    table = model.parameters(spark)
    stored = emstep.weighted_patterns(answers, VARIABLES)
    likelihoods = []
    for _ in range(3):
        level, shares, probs = latent._em_pass(patterns, {0: (shares, probs)})[0]
        table = spark.createDataFrame(emstep.lca_em_step(answers, table, stored).collect(), "class int, share double, variable string, level string, prob double, log_likelihood double")
        rows = {(r["class"], r.variable, r.level): r for r in table.collect()}
        likelihoods.append(level)
        assert {round(r.log_likelihood, 6) for r in rows.values()} == {round(level, 6)}
        for j, v in enumerate(patterns.coding.variables):
            for i, lv in enumerate(patterns.coding.levels[j]):
                for c in range(2):
                    r = rows[c + 1, v, str(lv)]
                    assert r.prob == pytest.approx(probs[patterns.coding.starts[j] + i, c], abs=1e-10)
                    assert r.share == pytest.approx(shares[c], abs=1e-10)
    patterns.release()
    assert likelihoods == sorted(likelihoods)


def test_em_step_edges(spark):
    df = spark.createDataFrame([(1, 1), (1, 2), (7, 1), (None, 1)], "a int, b int")
    rows = [(1, 1.0, "a", "1", 1.0), (1, 1.0, "a", "2", 0.0), (1, 1.0, "b", "1", 0.5), (1, 1.0, "b", "2", 0.5),
            (2, 0.0, "a", "1", 0.3), (2, 0.0, "a", "2", 0.7), (2, 0.0, "b", "1", 0.5), (2, 0.0, "b", "2", 0.5)]
    params = spark.createDataFrame(rows, "class int, share double, variable string, level string, prob double")
    got = {(r["class"], r.variable, r.level): r for r in emstep.lca_em_step(df, params).collect()}
    # The rows with an unknown level and without a value are left out, so two remain.
    assert got[1, "a", "1"].log_likelihood == pytest.approx(2 * np.log(0.5))
    assert got[1, "b", "2"].prob == pytest.approx(0.5) and got[1, "a", "2"].prob == pytest.approx(0.0)
    assert got[2, "a", "1"].share < 1e-200
    with pytest.raises(ValueError, match="empty"):
        emstep.lca_em_step(df, params.where("false"))


def test_posterior_is_expressions_only(spark, answers):
    model = latent.lca_fit(answers, 2, VARIABLES, n_rep=2)
    scored = model.transform(answers)
    plan = scored._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
    rows = scored.collect()
    levels = dict(zip(model.coding.variables, model.coding.levels))
    starts = dict(zip(model.coding.variables, model.coding.starts))
    for r in rows:
        if None in (r.a, r.d):
            assert r.posterior is None and r.class_assignment is None
            continue
        joint = model.shares * np.prod([model.probs[starts[v] + levels[v].index(r[v])] for v in VARIABLES], axis=0)
        assert np.allclose(r.posterior, joint / joint.sum(), atol=1e-12)
        assert r.class_assignment == int(np.argmax(r.posterior)) + 1
    # A stored parameter table gives the same model again.
    again = latent.LatentClassModel.from_parameters(model.parameters(spark)).transform(answers)
    assert [r.class_assignment for r in again.orderBy("id").collect()] == [r.class_assignment for r in sorted(rows, key=lambda r: r.id)]


def test_criteria_of_stored_parameters(spark, answers):
    """Tables of fitted models get the likelihood and the criteria that the fits report."""
    fits = [latent.lca_fit(answers, k, VARIABLES, n_rep=1, max_iter=60, accelerate=False, tol=0) for k in (2, 3)]
    found = latent.compare_parameters(answers, [m.parameters(spark) for m in fits])
    for model, fit in zip(found.models, fits):
        # The fit reports the likelihood before its last update, which can only raise it.
        assert model.n_rows == fit.n_rows == 3000 and model.n_classes == fit.n_classes
        assert fit.log_likelihood - 1e-6 <= model.log_likelihood < fit.log_likelihood + 5
    assert found.best_bic.n_classes == 2
    rows = found.metrics(spark).collect()
    assert [r.n_parameters for r in rows] == [2 * 4 + 1, 3 * 4 + 2]


def test_classes_of_a_fit_reach_outcomes(spark):
    """The chain on classes that the model itself found, to the areas of its classes."""
    t = star_tables(spark, "/root/testdata/sf0.001")
    rows = subgroups.lca_prepare(cohort.cohort_with_flags(t))
    model = latent.lca_fit(rows, 3, n_rep=2, max_iter=200)
    moved = subgroups.reassign_classes(model.transform(rows), k=2)
    table = subgroups.subgroup_table(moved)
    assert table.count() == rows.count() and {r[0] for r in table.select("class_assignment").distinct().collect()} <= {1, 2}
    counts = validation.class_scores(moved, ["age_at_admission", "gender", "admission_type"], order=["icustay_id"], folds=4)
    areas = validation.class_auc(counts).collect()
    assert len(areas) == 2 and all(0 <= r.auc <= 1 for r in areas)


# ---- k-means ------------------------------------------------------------------------------


def fixture_points(name):
    rng = np.random.default_rng(5)
    if name == "blobs":
        centres = rng.uniform(-50, 50, size=(6, 3))
        return np.round(centres[rng.integers(0, 6, 900)] + rng.normal(scale=1.5, size=(900, 3)), 3)
    if name == "flags and age":
        return np.column_stack([(rng.uniform(size=(1500, 8)) < 0.2).astype(float), rng.integers(16, 96, 1500).astype(float)])
    return np.repeat(rng.integers(0, 4, size=(12, 2)).astype(float), 40, axis=0)


@pytest.mark.parametrize("name", ["blobs", "flags and age", "repeated"])
def test_inertia_is_no_worse_than_the_library_one(spark, name):
    x = fixture_points(name)
    names = [f"f{j}" for j in range(x.shape[1])]
    df = spark.createDataFrame([tuple(map(float, r)) for r in x], ", ".join(f"{n} double" for n in names)).repartition(4)
    fit = kmeans.kmeans_fit(df, names, 6)
    vectors = VectorAssembler(inputCols=names, outputCol="v").transform(df)
    other = KMeans(featuresCol="v", k=6, seed=0, maxIter=300, tol=1e-4).fit(vectors)
    assert fit.inertia <= other.summary.trainingCost * (1 + 1e-9) + 1e-9
    direct = ((x[:, None, :] - fit.centers[None]) ** 2).sum(axis=2)
    assert fit.inertia == pytest.approx(direct.min(axis=1).sum()) and fit.n_rows == len(x)
    assigned = fit.transform(df).collect()
    assert [r.cluster for r in assigned] == [int(np.argmin(((np.array(r[:-1]) - fit.centers) ** 2).sum(axis=1))) for r in assigned]
    # The same fit however the rows are dealt.
    assert np.allclose(kmeans.kmeans_fit(df.repartition(3), names, 6).centers, fit.centers)


def test_kmeans_edges(spark):
    df = spark.createDataFrame([(1.0, 2.0), (1.0, 2.0), (5.0, 5.0), (None, 1.0), (float("nan"), 1.0)], "a double, b double")
    fit = kmeans.kmeans_fit(df, ["a", "b"], 4)
    assert fit.k == 2 and fit.inertia == 0 and fit.n_rows == 3
    assert [r.cluster for r in fit.transform(df.where("a = 1 or a is null")).collect()] == [0, 0, None]
    with pytest.raises(ValueError, match="no complete row"):
        kmeans.kmeans_fit(df.where("a is null"), ["a", "b"], 2)


# ---- logistic sums ------------------------------------------------------------------------


def test_logit_sums_match_the_solver(spark):
    rng = np.random.default_rng(9)
    x = rng.normal(size=(500, 3)).round(1)
    cls, fold = rng.integers(1, 4, 500), rng.integers(0, 5, 500)
    rows = [(*map(float, r), int(c), int(f)) for r, c, f in zip(x, cls, fold)] + [(None, 1.0, 1.0, 1, 0)]
    df = spark.createDataFrame(rows, "f0 double, f1 double, f2 double, class_assignment int, fold int")
    weights = {c: rng.normal(size=4).tolist() for c in (1, 2, 3)}
    got = {(r.class_assignment, r.fold, r.quantity, r.term_a, r.term_b): r.value for r in logit.logit_sums(df, ["f0", "f1", "f2"], weights).collect()}
    names = ["intercept", "f0", "f1", "f2"]
    design = np.insert(x, 0, 1.0, axis=1)
    assert len(got) == 3 * 5 * (1 + 4 + 10)
    for c, w in weights.items():
        for f in range(5):
            keep = fold != f
            d, y = design[keep], (cls[keep] == c).astype(float)
            eta = d @ np.array(w)
            p = 1 / (1 + np.exp(-eta))
            assert got[c, f, "loss", None, None] == pytest.approx((np.logaddexp(0, eta) - y * eta).sum())
            gradient, curvature = d.T @ (p - y), (d * (p * (1 - p))[:, None]).T @ d
            for i, a in enumerate(names):
                assert got[c, f, "gradient", a, None] == pytest.approx(gradient[i])
                for j in range(i, 4):
                    assert got[c, f, "curvature", a, names[j]] == pytest.approx(curvature[i, j])


def test_logit_sums_at_large_weights(spark):
    df = spark.createDataFrame([(1.0, 1, 0), (-1.0, 2, 1), (1.0, 2, 0)], "f double, class_assignment int, fold int")
    got = {(r.class_assignment, r.fold, r.quantity, r.term_a): r.value for r in logit.logit_sums(df, ["f"], {1: [0.0, 800.0], 2: [0.0, -800.0]}).collect()}
    assert got[1, 1, "loss", None] == pytest.approx(800.0) and np.isfinite(list(got.values())).all()


# ---- folds along row order ----------------------------------------------------------------


def plain_folds(y, folds):
    """Stratified folds without shuffling: labels by first appearance, dealt in turn, filled in order."""
    labels = list(dict.fromkeys(y))
    codes = [labels.index(v) for v in y]
    ordered_codes = sorted(codes)
    out = [None] * len(y)
    for k in range(len(labels)):
        dealt = [sum(1 for v in ordered_codes[i::folds] if v == k) for i in range(folds)]
        fill = iter([i for i, n in enumerate(dealt) for _ in range(n)])
        for place, code in enumerate(codes):
            if code == k:
                out[place] = next(fill)
    return out


@pytest.mark.parametrize("folds", [2, 5, 10])
def test_ordered_folds(spark, folds):
    rng = np.random.default_rng(folds)
    cls = rng.choice([3, 1, 7], p=[0.7, 0.25, 0.05], size=403).tolist()
    df = spark.createDataFrame([(i, c) for i, c in enumerate(cls)] + [(1000, None)], "id int, c int").repartition(7)
    got = {r.id: r.folds for r in validation.ordered_folds(df, "c", ["id"], folds).collect()}
    assert len(got) == 403
    for k, target in enumerate([1, 3, 7]):
        assert [got[i][k] for i in range(403)] == plain_folds([v == target for v in cls], folds)
    long = validation.target_folds(validation.ordered_folds(df, "c", ["id"], folds), "c", ["id"])
    assert long.count() == 3 * 403
    assert validation.ordered_folds(df.where("c is null"), "c", ["id"], folds).count() == 0


def test_scores_with_a_fold_per_target(spark):
    """With one model per target and fold, held out as that target's folds say."""
    rng = np.random.default_rng(2)
    x = rng.normal(size=(300, 2))
    cls = 1 + (x[:, 0] + rng.normal(scale=0.5, size=300) > 0).astype(int) + (x[:, 1] > 1)
    df = spark.createDataFrame([(i, int(c), float(a), float(b)) for i, (c, (a, b)) in enumerate(zip(cls, x))], "id int, class_assignment int, a double, b double")
    counts = validation.class_scores(df, ["a", "b"], order=["id"], folds=5)
    areas = {r.class_assignment: r.auc for r in validation.class_auc(counts).collect()}
    for target in (1, 2, 3):
        y = (cls == target).astype(float)
        fold = np.array(plain_folds((cls == target).tolist(), 5))
        score = np.zeros(300)
        d = np.insert(x, 0, 1.0, axis=1)
        for f in range(5):
            w = np.zeros(3)
            for _ in range(40):
                p = 1 / (1 + np.exp(-d[fold != f] @ w))
                ridge = np.array([0.0, 1.0, 1.0])
                gradient = d[fold != f].T @ (p - y[fold != f]) + ridge * w
                w -= np.linalg.solve((d[fold != f] * (p * (1 - p))[:, None]).T @ d[fold != f] + np.diag(ridge), gradient)
            score[fold == f] = 1 / (1 + np.exp(-d[fold == f] @ w))
        pos, neg = score[y == 1], score[y == 0]
        area = ((pos[:, None] > neg).sum() + 0.5 * (pos[:, None] == neg).sum()) / (len(pos) * len(neg))
        assert areas[target] == pytest.approx(area, abs=1e-6)


# ---- ordered lookups ----------------------------------------------------------------------


def test_pruned_curve_keeps_the_area(spark):
    rng = np.random.default_rng(1)
    rows = [(int(g), float(round(s, 2)), int(rng.uniform() < s)) for g, s in zip(rng.integers(0, 3, 4000), rng.uniform(size=4000))]
    df = spark.createDataFrame(rows, "g int, score double, label int")
    counts = roc.score_counts(df, group="g")
    whole, pruned = (roc.roc_points(counts, "g", prune=p).orderBy("g", F.desc("threshold")).collect() for p in (False, True))
    assert set(pruned) <= set(whole) and len(pruned) < len(whole)
    for g in range(3):
        def area(points):
            xy = [(0.0, 0.0)] + [(r.fpr, r.tpr) for r in points if r.g == g]
            return sum((b[0] - a[0]) * (a[1] + b[1]) / 2 for a, b in zip(xy, xy[1:]))
        assert area(pruned) == pytest.approx(area(whole), abs=1e-12)
        one = sorted(((r.threshold, r.pos, r.neg) for r in counts.collect() if r.g == g), reverse=True)
        kept = [t for i, (t, p, n) in enumerate(one) if i in (0, len(one) - 1) or (p, n) != one[i + 1][1:]]
        assert [r.threshold for r in pruned if r.g == g] == kept


def test_following_rows_cross_slices(spark):
    df = spark.range(1000).selectExpr("id", "id % 2 as g", "id * 10 as v").repartition(9)
    got = ordered.running_totals(df, ["id"], {"v": "s"}, "g", following={"v": "next_v", "id": "next_id"}).collect()
    assert all(r.next_v == (r.id + 2) * 10 if r.id < 998 else r.next_v is None and r.next_id is None for r in got)
    back = ordered.running_totals(df, ["id"], {"v": "s"}, "g", descending=True, following={"v": "next_v"}).collect()
    assert all(r.next_v == (r.id - 2) * 10 if r.id > 1 else r.next_v is None for r in back)


def test_outlier_rows(spark):
    values = [("hot", float(v % 50)) for v in range(20_000)] + [("hot", 500.0), ("hot", -400.0)] + [(f"g{k}", float(k)) for k in range(300)]
    values += [(None, float(v)) for v in (1, 2, 3, 4, 90)] + [("hot", None), ("hot", float("nan"))]
    df = spark.createDataFrame([(i, g, v) for i, (g, v) in enumerate(values)], "id int, g string, v double").repartition(8)
    got = {(r.g, r.v): r.fence for r in ordered.boxplot_outliers(df, "g", "v").collect()}
    q1, q3 = np.quantile([v for g, v in values if g == "hot" and v is not None and not np.isnan(v)], [0.25, 0.75])
    assert got == {("hot", 500.0): q3 + 1.5 * (q3 - q1), ("hot", -400.0): q1 - 1.5 * (q3 - q1), (None, 90.0): 7.0}


def test_lookup_of_heavy_and_light_keys(spark):
    rows = spark.range(30_000).selectExpr("id", "case when id % 3 = 0 then 'hot' when id % 7 = 0 then null else cast(id % 4000 as string) end as k").repartition(6)
    lookup = rows.groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("least"))
    met = ordered.lookup_rows(rows, lookup, ["k"], "n")
    assert met.columns == ["id", "k", "n", "least"] and met.count() == 30_000
    again = met.groupBy("k").agg(F.count(F.lit(1)).alias("m"), F.max("n").alias("n"), F.min("id").alias("a"), F.max("least").alias("b"))
    assert again.where("m <> n or a <> b").count() == 0


def test_fixed_tables_are_probabilities(spark):
    rows = catalog.model_rows(star_tables(spark, "/root/testdata/sf0.001"))
    sums = catalog.fixed_parameters(rows).groupBy("class", "variable").agg(F.sum("prob").alias("p"), F.max("share").alias("s")).collect()
    assert all(r.p == pytest.approx(1.0) for r in sums) and len(sums) == 3 * 33


def _wide_answers(spark, rows: int = 9000):
    """Rows with nearly as many answer patterns, one variable of them wide, one of text."""
    drawn = np.random.default_rng(11).integers(0, 2, (rows, 14))
    data = [(i % 37, "ab"[i % 2], *map(int, row)) for i, row in enumerate(drawn)]
    names = ["age", "kind", *[f"v{j}" for j in range(14)]]
    return spark.createDataFrame(data, f"age int, kind string, {', '.join(f'{n} int' for n in names[2:])}"), names


def test_a_pass_over_the_patterns_is_one_stage_over_several_tasks(spark):
    df, names = _wide_answers(spark)
    patterns = latent.Patterns(df, names)
    start = latent._random_start(patterns.coding, 3, np.random.default_rng(1))
    latent._em_pass(patterns, {0: (start.shares, start.probs)})
    spark.sparkContext.setJobGroup("one-pass", "one pass")
    try:
        latent._em_pass(patterns, {0: (start.shares, start.probs)})
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    tracker = spark.sparkContext.statusTracker()
    jobs = tracker.getJobIdsForGroup("one-pass")
    stages = [tracker.getStageInfo(s) for job in jobs for s in tracker.getJobInfo(job).stageIds]
    patterns.release()
    ran = [s.numTasks for s in stages if s is not None and s.numCompletedTasks]
    assert patterns.partitions > 1 and len(jobs) == 1 and ran == [patterns.partitions]


@pytest.mark.parametrize("direct", [64, 1])
def test_a_pass_sums_what_the_formula_says(spark, monkeypatch, direct):
    monkeypatch.setattr(latent, "BLOCK", 500)  # several blocks in a task
    monkeypatch.setattr(latent, "DIRECT_TASKS", direct)
    df, names = _wide_answers(spark)
    patterns = latent.Patterns(df.union(df.limit(100)), names)
    starts, rng = patterns.coding.starts, np.random.default_rng(2)
    points = {k: latent._random_start(patterns.coding, classes, rng) for k, classes in enumerate((1, 2, 4))}
    found = latent._em_pass(patterns, {k: (p.shares, p.probs) for k, p in points.items()})
    patterns.release()
    rows = [*df.collect(), *df.limit(100).collect()]
    codes = np.array([[lv.index(row[v]) for v, lv in zip(names, patterns.coding.levels)] for row in rows])
    hot = latent._one_hot(codes, starts)
    assert patterns.n_rows == len(rows)
    for k, point in points.items():
        joint = np.exp(hot @ np.log(point.probs) + np.log(point.shares))
        post = joint / joint.sum(axis=1, keepdims=True)
        level, shares, probs = found[k]
        assert np.isclose(level, np.log(joint.sum(axis=1)).sum(), rtol=1e-12)
        assert np.allclose(shares, post.mean(axis=0), rtol=1e-11)
        assert np.allclose(probs, hot.T @ post / post.sum(axis=0), rtol=1e-11)


def test_a_fit_is_one_job_however_many_steps_it_takes(spark):
    df, names = _wide_answers(spark, 800)
    patterns = latent.Patterns(df, names)
    spark.sparkContext.setJobGroup("one-fit", "one fit")
    try:
        models = latent.fit_patterns(patterns, [2, 3], max_iter=40, tol=0, n_rep=2)
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    tracker = spark.sparkContext.statusTracker()
    tasks = [tracker.getStageInfo(s).numTasks for job in tracker.getJobIdsForGroup("one-fit") for s in tracker.getJobInfo(job).stageIds if tracker.getStageInfo(s)]
    assert [m.iterations for m in models] == [40, 40]
    # Besides the job that sends the patterns (their stages), one job with a task for each start.
    assert len(tracker.getJobIdsForGroup("one-fit")) == 2 and 4 in tasks


@pytest.mark.parametrize("accelerate", [True, False])
def test_starts_climb_alike_apart_and_together(spark, accelerate):
    df, names = _wide_answers(spark, 3000)
    patterns = latent.Patterns(df.union(df.limit(500)), names)
    apart = latent.fit_patterns(patterns, [1, 3], max_iter=50, n_rep=2, accelerate=accelerate)
    assert patterns.in_one_task and patterns.partitions > 1
    patterns.in_one_task = False  # as with more patterns than one task takes
    together = latent.fit_patterns(patterns, [1, 3], max_iter=50, n_rep=2, accelerate=accelerate)
    patterns.release()
    for a, b in zip(apart, together):
        assert (a.iterations, a.converged, a.n_rows) == (b.iterations, b.converged, b.n_rows)
        assert np.isclose(a.log_likelihood, b.log_likelihood, rtol=1e-11)
        assert np.allclose(a.shares, b.shares, rtol=1e-6) and np.allclose(a.probs, b.probs, atol=1e-7)


@pytest.mark.parametrize("most", [4, 2048])
def test_sums_of_patterns_that_no_class_makes_likely(monkeypatch, most):
    monkeypatch.setattr(latent, "LEAST_ANSWERS", most)
    rng = np.random.default_rng(6)
    starts = np.cumsum([0, 5, *[2] * 12])
    codes = np.column_stack([rng.integers(0, 5, 700), rng.integers(0, 2, (700, 12))]).astype(np.uint8)
    weight = rng.integers(1, 9, 700).astype(float)
    # Each class rules out one of two answers of half of the variables: nearly all patterns are impossible for both.
    probs = np.zeros((starts[-1], 2))
    probs[:5] = 0.2
    for j in range(12):
        probs[starts[j + 1] + np.array([0, 1])] = 0.5
        probs[starts[j + 1] + np.array([0, 1]), j % 2] = (0.0, 1.0)
    shares = np.array([0.3, 0.7])
    level, counts = latent._Part(codes, weight, starts, 300).sums(shares, probs)
    hot = latent._one_hot(codes, starts)
    joint = hot @ np.log(np.maximum(probs, emstep.TINY)) + np.log(shares)
    top = joint.max(axis=1, keepdims=True)
    post = np.exp(joint - top)
    mass = post.sum(axis=1, keepdims=True)
    assert np.isclose(level, weight @ (np.log(mass) + top)[:, 0], rtol=1e-12)
    assert np.allclose(counts, hot.T @ (post / mass * weight[:, None]), rtol=1e-10, atol=1e-200)


def _jobs(spark, group: str, work) -> int:
    spark.sparkContext.setJobGroup(group, group)
    try:
        work()
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    return len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))


def test_posteriors_of_a_fit_take_no_more_jobs_for_more_steps(spark):
    df, names = _wide_answers(spark, 500)
    score = lambda steps: latent.lca_fit(df, 3, names, max_iter=steps, tol=0, n_rep=2).transform(df).count()
    assert _jobs(spark, "few-posterior", lambda: score(4)) == _jobs(spark, "many-posterior", lambda: score(31))


def test_a_selection_takes_no_more_jobs_for_more_steps(spark):
    df, names = _wide_answers(spark, 500)
    select = lambda steps: latent.lca_select(df, [2, 3, 4], names, max_iter=steps, tol=0, n_rep=1)
    assert _jobs(spark, "few-select", lambda: select(4)) == _jobs(spark, "many-select", lambda: select(31))
