from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from wardstat.operators import cluster, latent, network, subgroups


def pair_table(df):
    return {(r.a, r.b): r.n for r in df.collect()}


def test_tiny_cooccurrence(spark):
    df = spark.createDataFrame([(1, 1, 0), (1, 2, 0), (0, 1, None), (0, 0, 0)], "x int, y int, z int")
    pairs = network.cooccurrence(df, ["x", "y", "z"])
    assert pair_table(pairs) == {
        ("x", "x"): 2, ("x", "y"): 2, ("x", "z"): 0,
        ("y", "x"): 2, ("y", "y"): 3, ("y", "z"): 0,
        ("z", "x"): 0, ("z", "y"): 0, ("z", "z"): 0,
    }
    edges = {(r["from"], r["to"]): (r.weight, r.weight_pct) for r in network.network_edges(pairs).collect()}
    assert edges == {("x", "y"): (2, 1.0), ("y", "x"): (2, 1.0)}
    assert network.network_edges(pairs, unique=True).count() == 1
    nodes = {r.name: r for r in network.network_nodes(pairs).collect()}
    assert nodes["x"].total_cooccurrences == 4 and nodes["y"].total_cooccurrences == 5
    assert nodes["y"].total_pct == pytest.approx(500 / 9) and nodes["y"].node_size == pytest.approx(500 / 9)
    assert {r.name: r.total_cooccurrences for r in network.network_nodes(pairs, diagonal=False).collect()} == {"x": 2, "y": 2, "z": 0}


def test_node_size_is_capped(spark):
    df = spark.createDataFrame([(1, 0)], "x int, y int")
    nodes = {r.name: r.node_size for r in network.network_nodes(network.cooccurrence(df, ["x", "y"])).collect()}
    assert nodes == {"x": 60.0, "y": 0.0}


def test_cooccurrence_invariants(spark):
    df = spark.range(3000).selectExpr(
        "if(id % 3 = 0, 2, 1) as g", *[f"cast(hash(id, {i}) % {i + 2} = 0 as int) as f{i}" for i in range(6)]
    )
    names = [f"f{i}" for i in range(6)]
    whole = pair_table(network.cooccurrence(df, names))
    assert all(whole[a, b] == whole[b, a] for a, b in whole) and len(whole) == 36
    sums = df.agg(*[F.sum(n).alias(n) for n in names]).first()
    assert all(whole[n, n] == sums[n] for n in names)
    split = network.cooccurrence(df, names, "g").groupBy("a", "b").agg(F.sum("n").alias("n"))
    assert pair_table(split) == whole


def test_reassign_classes_tie_goes_to_the_more_frequent_class(spark):
    rows = [(1, 3, [0.1, 0.4, 0.4]), (2, 3, [0.0, 0.2, 0.8]), (3, 2, [0.9, 0.05, 0.05]), (4, 1, [0.2, 0.5, 0.3]), (5, 2, [0.0, 0.9, 0.1]), (6, 3, [0.3, 0.2, 0.5])]
    df = spark.createDataFrame(rows, "id int, class_assignment int, posterior array<double>")
    assert subgroups.top_classes(df, k=2) == [3, 2]
    got = {r.id: r.class_assignment for r in subgroups.reassign_classes(df, k=2).collect()}
    assert got == {1: 3, 2: 3, 3: 3, 4: 2, 5: 2, 6: 3}


def test_subgroup_table(spark):
    rows = [(i, 4 if i % 2 else 9, *[2 if j < n else 1 for j in range(9)]) for i, n in enumerate([0, 1, 8, 1, 9, 1])]
    flags = [f"f{j}" for j in range(9)]
    df = spark.createDataFrame(rows, "subject_id int, class_assignment int, " + ", ".join(f"{f} int" for f in flags))
    table = subgroups.subgroup_table(df, flags, class_map={1: 2, 2: 1})
    got = {r.subject_id: (r.class_assignment, r.count_morbidity, r.percent) for r in table.collect()}
    third = pytest.approx(100 / 3)
    assert got == {0: (1, "0", third), 2: (1, ">=8", pytest.approx(200 / 3)), 4: (1, ">=8", pytest.approx(200 / 3)),
                   1: (2, "1", 100.0), 3: (2, "1", 100.0), 5: (2, "1", 100.0)}
    assert [r.count_morbidity for r in table.collect()][-1] == ">=8"
    assert {r.f0 for r in table.collect()} == {0, 1}


@pytest.fixture(scope="module")
def mixture(spark):
    """3 classes and 8 binary variables with known parameters."""
    rng = np.random.default_rng(7)
    shares = np.array([0.5, 0.3, 0.2])
    truth = np.array([[0.9] * 4 + [0.1] * 4, [0.1] * 4 + [0.9] * 4, [0.9, 0.1] * 4])
    cls = rng.choice(3, size=5000, p=shares)
    x = (rng.uniform(size=(5000, 8)) < truth[cls]).astype(int) + 1
    names = [f"v{i}" for i in range(8)]
    rows = [(i, int(c) + 1, *map(int, r)) for i, (c, r) in enumerate(zip(cls, x))]
    df = spark.createDataFrame(rows, "id int, true_class int, " + ", ".join(f"{n} int" for n in names))
    return df, names, shares, truth


def test_lca_recovers_a_planted_mixture(mixture):
    df, names, shares, truth = mixture
    model = latent.lca_fit(df, 3, names, n_rep=3)
    assert model.converged and model.n_rows == 5000
    assert list(model.shares) == sorted(model.shares, reverse=True)
    assert np.allclose(model.shares, shares, atol=0.03)
    assert np.allclose(model.probs[1::2].T, truth, atol=0.05)  # probability of the higher level
    assert model.n_parameters == 3 * 8 + 2
    assert model.aic == pytest.approx(-2 * model.log_likelihood + 2 * 26)
    assert model.bic == pytest.approx(-2 * model.log_likelihood + 26 * math.log(5000))
    scored = model.transform(df)
    assert scored.where("class_assignment = true_class").count() > 4500
    worst = scored.selectExpr("max(abs(aggregate(posterior, 0D, (a, v) -> a + v) - 1))")
    assert worst.first()[0] < 1e-9


def test_lca_likelihood_matches_a_direct_sum(mixture):
    df, names, *_ = mixture
    model = latent.lca_fit(df, 2, names, n_rep=1, max_iter=5)
    x = df.select(*names).toPandas().to_numpy() - 1
    p = model.probs[1::2]
    joint = np.stack([np.prod(np.where(x == 1, p[:, r], 1 - p[:, r]), axis=1) * model.shares[r] for r in range(2)])
    patterns = latent.Patterns(df, names)
    level = latent._em_pass(patterns, {0: (model.shares, model.probs)})[0][0]
    patterns.release()
    assert level == pytest.approx(np.log(joint.sum(axis=0)).sum())


def test_lca_likelihood_never_falls(mixture):
    df, names, *_ = mixture
    patterns = latent.Patterns(df, names)
    for accelerate in (False, True):
        levels = [latent.fit_patterns(patterns, [3], max_iter=k, n_rep=1, accelerate=accelerate)[0].log_likelihood for k in (1, 4, 7, 10, 13)]
        assert all(b >= a - 1e-9 for a, b in zip(levels, levels[1:]))
    patterns.release()


def test_acceleration_reaches_the_same_fit_in_fewer_steps(mixture):
    df, names, *_ = mixture
    patterns = latent.Patterns(df, names)
    plain, fast = (latent.fit_patterns(patterns, [3], n_rep=2, tol=1e-7, accelerate=a)[0] for a in (False, True))
    patterns.release()
    assert fast.log_likelihood == pytest.approx(plain.log_likelihood, abs=1e-3)
    assert fast.iterations < plain.iterations


def test_selection_prefers_the_planted_number_of_classes(spark, mixture):
    df, names, *_ = mixture
    found = latent.lca_select(df, [2, 3, 4], names, n_rep=2)
    assert found.best_bic.n_classes == 3 and found.best_combined.n_classes == 3
    rows = found.metrics(spark).collect()
    assert [r.n_classes for r in rows] == [2, 3, 4] and sum(r.best_bic for r in rows) == 1
    assert found.best_bic.parameters(spark).count() == 3 * 16


def test_lca_drops_incomplete_rows_and_constant_variables(spark):
    rows = [(1 + i % 2, 1 + (i // 2) % 3, 1) for i in range(60)] + [(None, 1, 1)]
    df = spark.createDataFrame(rows, "a int, b int, constant int")
    model = latent.lca_fit(df, 2, ["a", "b", "constant"], n_rep=1, max_iter=20)
    assert model.n_rows == 60 and model.coding.variables == ["a", "b"]
    scored = model.transform(df.unionByName(spark.createDataFrame([(9, 1, 1)], df.schema)))
    assert scored.where("class_assignment is null").count() == 2  # missing and unseen values


def test_parameter_count_uses_the_highest_code_of_positive_integers():
    coding = latent.Coding(["age", "sex"], [[16, 40], [0, 1]], [40, 2])
    assert coding.free_parameters(3) == 3 * (39 + 1) + 2


def test_kmeans_recovers_planted_blobs(spark):
    rng = np.random.default_rng(7)
    centres = np.array([[0, 0, 20], [9, 0, 40], [0, 9, 60], [9, 9, 80]])
    rows = [(int(c), "M" if i % 2 else None, *map(float, centres[c] + rng.normal(scale=0.3, size=3))) for i, c in enumerate(rng.integers(0, 4, 800))]
    df = spark.createDataFrame(rows, "truth int, gender string, x double, y double, age_at_admission double")
    _, clustered = cluster.kmeans_rows(df, ["x", "y"], k=4, include_gender=True, bin_age=True)
    assert clustered.columns == ["x", "y", "age_at_admission", "gender", "cluster", "age_group"]
    sizes = clustered.groupBy("cluster").agg(F.count(F.lit(1)).alias("n"), F.stddev("age_at_admission").alias("s")).collect()
    assert len(sizes) == 4 and all(r.s < 1 for r in sizes)
    profile = cluster.cluster_profile(clustered.where("age_group is not null"), ["x", "y"])
    assert profile.count() == 4
    # Means within an age group and cluster stay at the planted centres.
    assert {(round(r.x / 9), round(r.y / 9)) for r in profile.collect()} == {(0, 0), (1, 0), (0, 1), (1, 1)}


def test_kmeans_profiles(spark):
    rows = [(g, s, i) for g in ("16-24", "25-44", "45-64") for s in ("M", "F") for i in range(4)]
    df = spark.createDataFrame([(g, s, float(g == "45-64"), float(i > 1)) for g, s, i in rows] + [(None, "M", 1.0, 1.0)], "age_group string, gender string, p double, q double")
    _, profiles = cluster.kmeans_profiles(df, ["p", "q"], k=2)
    got = {(r.age_group, r.gender): r.cluster for r in profiles.collect()}
    assert len(got) == 6 and len({c for (g, _), c in got.items() if g == "45-64"}) == 1
    _, coarse = cluster.kmeans_profiles(df, ["p", "q"], k=2, by_gender=False)
    assert coarse.count() == 3
