"""Kernels and statistics against numpy or by hand; guards for nulls, constants and ties."""

from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from prismal.functions import aggregate as A, scalar as S, special as P
from prismal.operators import disagreement as D, inference as I, kernels as K, ridge as R, simulation as M, tables as O


def _features(spark, x: np.ndarray, grp: int = 0):
    rows = [(grp, f"m{m}", i, [float(v) for v in x[m, i]]) for m in range(x.shape[0]) for i in range(x.shape[1])]
    return spark.createDataFrame(rows, "grp long, model string, image_id long, v array<double>")


def _numpy_profile(x: np.ndarray, metric: str) -> np.ndarray:
    if metric == "euclidean":
        d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2))
    elif metric.startswith("cosine"):
        u = x / np.linalg.norm(x, axis=1, keepdims=True)
        d = 1 - u @ u.T
    else:
        d = 1 - np.corrcoef(x) * ((x.shape[1] - 1) / x.shape[1] if metric == "correlation_scaled" else 1)
    return d[np.triu_indices(len(x), 1)]


@pytest.mark.parametrize("metric", K.METRICS)
def test_profiles_equal_numpy(spark, metric):
    x = np.random.default_rng(1).normal(size=(2, 6, 5))
    got = K.distance_profile(_features(spark, x), metric).orderBy("model", "i", "j").toPandas()
    want = np.concatenate([_numpy_profile(x[m], metric) for m in range(2)])
    assert np.allclose(got["d"], want, atol=1e-6)


@pytest.mark.parametrize("block", [1, 4, 7, 512])
def test_images_in_several_blocks_meet_once(spark, monkeypatch, block):
    monkeypatch.setattr(K, "BLOCK", block)
    x = np.random.default_rng(11).normal(size=(2, 13, 5))
    got = K.distance_profile(_features(spark, x), "euclidean").orderBy("model", "i", "j").toPandas()
    assert [tuple(p) for p in got[["i", "j"]].to_numpy()] == 2 * list(zip(*np.triu_indices(13, 1)))
    assert np.allclose(got["d"], np.concatenate([_numpy_profile(x[m], "euclidean") for m in range(2)]))


def test_unknown_options_raise(spark):
    f = _features(spark, np.ones((1, 2, 2)))
    for call in (lambda: K.distance_profile(f, "x"), lambda: K.ranked(f, "x"), lambda: D.fold(F.col("r"), "x"), lambda: D.normalised(F.col("r"), "x", "grp")):
        with pytest.raises(ValueError):
            call()


def test_spearman_survives_monotone_maps_and_constants(spark):
    x = np.random.default_rng(2).normal(size=(1, 8, 4))
    p = K.distance_profile(_features(spark, x), "euclidean")
    other = p.withColumn("model", F.lit("m1")).withColumn("d", F.exp("d"))
    flat = p.withColumn("model", F.lit("m2")).withColumn("d", F.lit(1.0))
    r = {(a, b): v for _, a, b, _, v in K.agreement(p.unionByName(other).unionByName(flat)).collect()}
    assert r["m0", "m1"] == pytest.approx(1.0)
    assert r["m0", "m2"] is None
    total = {(x["model_a"], x["model_b"]): x["r"] for x in K.total_agreement(p.unionByName(flat).unionByName(flat.withColumn("model", F.lit("m3")))).collect()}
    assert total["m0", "m2"] == 0.0 and total["m2", "m3"] == 1.0


def test_mean_pair_distance_equals_all_pairs(spark):
    x = [3.0, 1.0, 4.0, 1.0, 5.0]
    got = spark.createDataFrame([(v,) for v in x], "v double").agg(A.mean_pair_distance(F.col("v")).alias("g")).first()["g"]
    assert got == pytest.approx(np.mean([abs(a - b) for i, a in enumerate(x) for b in x[i + 1 :]]))


def test_guards(spark):
    x = spark.createDataFrame([(1.0, 0.0), (float("nan"), 4.0), (float("inf"), None)], "a double, b double")
    rows = x.select(S.finite_or_null(F.col("a")).alias("f"), S.positive_ratio(F.lit(2.0), F.col("b")).alias("r")).collect()
    assert [tuple(r) for r in rows] == [(1.0, None), (None, 1.0), (None, None)]
    assert x.agg(A.correlation(F.lit(1.0), F.col("b")).alias("c")).first()["c"] is None
    assert S.stable_seed("a", 1) == S.stable_seed("a", 1) != S.stable_seed("a", 2)


def test_index_list_and_natural_key(spark):
    x = spark.createDataFrame([("1,3-5",), ("7",)], "s string").select(S.index_list(F.col("s")).alias("x")).collect()
    assert [r["x"] for r in x] == [[1, 3, 4, 5], [7]]
    names = ["sub-10", "sub-9", "sub-1"]
    got = spark.createDataFrame([(n,) for n in names], "n string").orderBy(S.natural_key(F.col("n"))).collect()
    assert [r["n"] for r in got] == ["sub-1", "sub-9", "sub-10"]


def test_adjustments_are_monotone_and_bounded(spark):
    p = [0.001, 0.04, 0.03, 0.5, None]
    df = spark.createDataFrame([("s", i, v) for i, v in enumerate(p)], "scope string, k int, p double")
    q = {r["k"]: r["q"] for r in I.benjamini_hochberg(df, ["scope"], "p", "k").collect()}
    assert q[4] is None
    assert [q[k] for k in (0, 2, 1, 3)] == pytest.approx([0.004, 0.04 * 4 / 3, 0.04 * 4 / 3, 0.5])
    h = {r["k"]: r["p_holm"] for r in I.holm(df, ["scope"], "p", "k").collect()}
    assert [h[k] for k in (0, 2, 1, 3)] == pytest.approx([0.004, 0.09, 0.09, 0.5])


def test_distribution_functions():
    assert P.t_tail(2.0, 10) * 2 == pytest.approx(0.07338803477074039, rel=1e-9)
    assert float(P.betainc(2.0, 3.0, 0.4)) == pytest.approx(0.5248, rel=1e-9)
    assert float(P.gammaq(1.0, 2.0)) == pytest.approx(math.exp(-2), rel=1e-12)
    assert float(P.gammaq(0.5, 0.5)) == pytest.approx(math.erfc(math.sqrt(0.5)), rel=1e-10)


def test_near_ties_count_as_defined(spark):
    df = spark.createDataFrame([(0, 0, 1, 1e-9), (1, 0, 1, -1e-9), (2, 0, 1, 1.0)], "sim int, model_i int, model_j int, margin double")
    r = I.discriminability(df).first()
    assert r["dominance"] == pytest.approx((1.5 + 0.5 + 1) / 3) and r["error"] == pytest.approx(1 / 3)


def test_group_margin_never_subtracts_a_negative(spark):
    s = spark.createDataFrame([(0, "a", "a", 0.9), (0, "a", "b", -0.5)], "grp int, model string, other string, r double")
    assert D.group_margin(s).first()["margin"] == pytest.approx(0.9)


def test_track_aggregates(spark):
    t = spark.createDataFrame([("x", 1, 2.0), ("y", 1, 4.0), ("x", 2, 1.0)], "track string, candidate long, score double")
    w = {r["candidate"]: r["score"] for r in D.track_aggregate(t, "weighted_mean", {"y": 3.0}).collect()}
    assert w == {1: 4.0, 2: None}  # a track without a weight weighs nothing
    p = {r["candidate"]: r["score"] for r in D.track_aggregate(t, "power_mean", {"y": 3.0}, 1.0).collect()}
    assert p[1] == pytest.approx(3.5)
    with pytest.raises(Exception, match="identity"):
        D.track_aggregate(t, "identity").collect()


def test_leave_one_out_ridge_equals_refits():
    rng = np.random.default_rng(3)
    x, y = rng.normal(size=(12, 4)), rng.normal(size=(12, 2))
    got = R.loo_predictions(x, y, [0.5])[0]
    for i in range(12):
        k = np.arange(12) != i
        xm, ym = x[k].mean(axis=0), y[k].mean(axis=0)
        w = np.linalg.solve((x[k] - xm).T @ (x[k] - xm) + 0.5 * np.eye(4), (x[k] - xm).T @ (y[k] - ym))
        # centring on the training rows changes the penalised fit only through the intercept
        assert np.allclose(got[i], (x[i] - xm) @ w + ym, atol=1e-8)


def test_mahalanobis_equals_numpy(spark):
    x = np.random.default_rng(4).normal(size=(40, 3))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "image_id long, v array<double>").repartition(5)
    got = R.mahalanobis(df, df).orderBy("image_id").toPandas()["distance"]
    inv = np.linalg.inv(np.cov(x.T) + 1e-6 * np.eye(3))
    d = x - x.mean(axis=0)
    assert np.allclose(got, np.sqrt(np.einsum("nd,de,ne->n", d, inv, d)))


def test_greedy_selection_equals_brute_force(spark):
    x = np.random.default_rng(5).normal(size=(3, 9, 4))
    chosen, history = D.greedy_select(_features(spark, x), 5, [0, 1, 2], "euclidean")

    def mean_r(ids):
        p = [_numpy_profile(x[m, ids], "euclidean") for m in range(3)]
        return np.mean([np.corrcoef(p[a], p[b])[0, 1] for a in range(3) for b in range(a + 1, 3)])

    have = [0, 1, 2]
    for step in history:
        best = min((i for i in range(9) if i not in have), key=lambda i: mean_r([*have, i]))
        have.append(best)
        assert step == pytest.approx(mean_r(have))
    assert chosen == have


def test_simulations_do_not_depend_on_partitions(spark):
    p = K.distance_profile(_features(spark, np.random.default_rng(6).normal(size=(3, 8, 4))), "cosine")
    a = M.noisy_agreement(p, 0.05, 4).orderBy("draw", "model_i", "model_j").toPandas()
    b = M.noisy_agreement(p.repartition(7), 0.05, 4).orderBy("draw", "model_i", "model_j").toPandas()
    assert a.equals(b)
    noise = M.noise_for_ceiling(p, 0.8, draws=8)
    r = M.noisy_agreement(p, noise, 8).where("model_i = model_j").agg(F.avg("r")).first()[0]
    assert abs(r - 0.8) < 0.02


def test_subsets_and_sign_flips(spark):
    assert I.subsets(spark, 4).count() == 4 * 2**3
    df = spark.createDataFrame([(i, 1.0 + i, 0.0) for i in range(4)], "u int, a double, b double")
    r = I.permutation_p(df, "u", "a", "b").first()
    assert r["p"] == pytest.approx(2 / 16) and r["n"] == 4


def test_leave_one_out_of_a_single_unit_is_null(spark):
    df = spark.createDataFrame([("g", 1, 2.0)], "g string, u int, x double")
    assert O.leave_one_out(df, ["g"], "u", "x").first()["mean_rest"] is None
    with pytest.raises(ValueError):
        O.assert_unique(df.unionByName(df), ["g", "u"])


def test_queries_without_sql_take_whole_tables(spark, tmp_path):
    from prismal.plans import kernels, statistics

    rng = np.random.default_rng(8)
    e = [(i, i % 2, [float(v) for v in rng.normal(size=64)]) for i in range(12)]
    spark.createDataFrame(e, "vec_id long, label int, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    chosen, _ = D.greedy_select(kernels.features(spark, str(tmp_path)), 8, [0, 1, 2])
    got = [r["image_id"] for r in kernels.greedy_selection(spark, str(tmp_path)).orderBy("place").collect()]
    assert got == chosen and len(got) == 8 and {i % 2 for i in got} == {0, 1}
    spark.createDataFrame([(k, "t", 1) for k in (1, 399, 400, 20_000)], "p_partkey long, p_type string, p_size int").write.parquet(f"{tmp_path}/part.parquet")
    assert statistics._pv(spark, str(tmp_path)).count() == 4


def test_readouts_of_a_group_spread_over_tasks_and_equal_numpy(spark):
    rng = np.random.default_rng(9)
    x = rng.normal(5.0, 2.0, size=(60, 4))
    x[:, 3] = 1000.1  # a constant predictor
    y = np.column_stack([x[:, 0] + rng.normal(size=60), rng.normal(size=60), np.full(60, 0.3)])
    rows = [(i % 2, i, x[i].tolist(), y[i].tolist()) for i in range(60)]
    df = spark.createDataFrame(rows, "grp long, image_id long, x array<double>, y array<double>").repartition(7)
    out, parts = R.ridge_loo(df), R.variance_partition(df.withColumn("y", F.col("y")[0]), {"a": [0], "b": [1, 2]})
    got, part = {(r["grp"], r["target"]): r for r in out.collect()}, {(r["grp"], r["family"]): r["unique_r2"] for r in parts.collect()}
    for plan in (out, parts):
        assert "FlatMapGroups" not in plan._jdf.queryExecution().toString()
    for g in range(2):
        k = np.arange(60) % 2 == g
        xs = R.standardised(x[k], x[k])
        r = np.array([R.column_correlation(p, y[k]) for p in R.loo_predictions(xs, y[k], [0.1, 1.0, 10.0])])
        for t in range(2):
            assert got[g, t]["alpha"] == [0.1, 1.0, 10.0][r[:, t].argmax()] and got[g, t]["r"] == pytest.approx(r[:, t].max(), abs=1e-9)
        assert got[g, 2]["r"] == 0.0

        def r2(c):
            a, b = xs[:, c], y[k, 0] - y[k, 0].mean()
            return 1 - ((b - a @ np.linalg.solve(a.T @ a + 100 * np.eye(len(c)), a.T @ b)) ** 2).sum() / (b**2).sum()

        assert part[g, "a"] == pytest.approx(r2([0, 1, 2, 3]) - r2([1, 2, 3])) and part[g, "b"] == pytest.approx(r2([0, 1, 2, 3]) - r2([0, 3]))


def test_matches_of_a_large_group_take_no_matrix_of_all_pairs():
    import tracemalloc

    import pandas as pd

    from prismal.operators import tables as O

    rng = np.random.default_rng(5)
    pdf = pd.DataFrame({"g": 0, "k": np.arange(6000), "a": rng.normal(size=6000), "b": rng.normal(size=6000), "_t": np.arange(6000) % 3 == 0})
    tracemalloc.start()
    got = O.matched(pdf, ["g"], "k", ["a", "b"])
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 10e6  # the matrix would take 64 MB
    z = pdf[["a", "b"]].to_numpy()
    z = (z - z.mean(axis=0)) / z.std(axis=0)
    own, other = np.flatnonzero(pdf["_t"]), np.flatnonzero(~pdf["_t"])
    d = np.sqrt(((z[own, None] - z[other]) ** 2).sum(axis=2))
    want, used = [], np.zeros(len(other), bool)
    for i in np.argsort(d.min(axis=1), kind="stable"):
        j = int(np.where(used, np.inf, d[i]).argmin())
        used[j] = True
        want.append((own[i], other[j]))
    assert list(zip(got["k"], got["match"])) == want
