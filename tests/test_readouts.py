"""Readouts from sums of products against fits of the rows themselves."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from prismal.operators import readout as R
from prismal.plans import catalog


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(3, 2, (90, 4))
    y = x @ rng.normal(size=(4, 2)) + rng.normal(0, 2, (90, 2)) + 50
    data = [(int(k % 2), k, x[k].tolist(), y[k].tolist()) for k in range(90)]
    return spark.createDataFrame(data, "grp long, image_id long, x array<double>, y array<double>").repartition(5), x, y, np.arange(90) % 2


def _ridge(x, y, alpha, new, w=None, scale=None):
    w = np.ones(len(x)) if w is None else w
    m, my = np.average(x, axis=0, weights=w), np.average(y, axis=0, weights=w)
    sd = np.sqrt(np.average((x - m) ** 2, axis=0, weights=w)) if scale is None else scale
    z = (x - m) / sd
    b = np.linalg.solve((z * w[:, None]).T @ z + alpha * np.eye(x.shape[1]), (z * w[:, None]).T @ (y - my))
    return (new - m) / sd @ b + my


def _folds(df, of, seed):
    return {r["image_id"]: r["f"] for r in df.select("image_id", R.fold_of(F.col("image_id"), of, seed).alias("f")).collect()}


def _r(a, b):
    return np.array([np.corrcoef(a[:, t], b[:, t])[0, 1] for t in range(a.shape[1])])


def test_kfold_equals_fits_of_each_fold(rows):
    df, x, y, g = rows
    fold = _folds(df, 5, 3)
    f = np.array([fold[k] for k in range(90)])
    got = {(r["grp"], r["target"]): r for r in R.kfold_ridge(df, (0.1, 100.0), 5, 3).collect()}
    for grp in (0, 1):
        own = g == grp
        per = []
        for a in (0.1, 100.0):
            out = np.zeros_like(y)
            for k in range(5):
                out[own & (f == k)] = _ridge(x[own & (f != k)], y[own & (f != k)], a, x[own & (f == k)])
            per.append(_r(out[own], y[own]))
        for t in (0, 1):
            best = int(np.argmax([p[t] for p in per]))
            assert got[grp, t]["alpha"] == (0.1, 100.0)[best] and got[grp, t]["r"] == pytest.approx(per[best][t])


def test_augmented_predictions_equal_refits_without_the_row(rows):
    df, x, y, g = rows
    part = np.arange(90) // 2 % 3
    marked = df.withColumn("split", F.element_at(F.array(F.lit("train"), F.lit("val"), F.lit("eval")), (F.floor(F.col("image_id") / 2) % 3 + 1).cast("int")))
    got = {(r["grp"], r["target"]): r for r in R.augmented_loo(marked, (0.1, 100.0)).collect()}
    for grp in (0, 1):
        own = np.flatnonzero(g == grp)
        val = [_r(_ridge(x[own][part[own] == 0], y[own][part[own] == 0], a, x[own][part[own] == 1]), y[own][part[own] == 1]) for a in (0.1, 100.0)]
        sd, ev = x[own].std(axis=0), own[part[own] == 2]
        loo = [np.array([_ridge(np.delete(x[own], np.flatnonzero(own == i), 0), np.delete(y[own], np.flatnonzero(own == i), 0), a, x[i], scale=sd) for i in ev]) for a in (0.1, 100.0)]
        for t in (0, 1):
            best = int(np.argmax([v[t] for v in val]))
            assert got[grp, t]["alpha"] == (0.1, 100.0)[best]
            assert got[grp, t]["r"] == pytest.approx(_r(loo[best], y[ev])[t], abs=1e-9)


def test_weighted_and_adapted_predictions_equal_weighted_refits(rows):
    df, x, y, g = rows
    own = np.flatnonzero(g == 0)
    target = own % 5 == 0
    got = {(r["grp"], r["target"], r["weight"]): r["r"] for r in R.adaptation(df.where("image_id % 5 <> 0"), df.where("image_id % 5 = 0"), 5.0, [0.2, 0.7]).collect()}
    for w in (0.2, 0.7):
        weight = np.where(target, w, 1 - w)
        sd = np.sqrt(np.average((x[own] - np.average(x[own], axis=0, weights=weight)) ** 2, axis=0, weights=weight))
        out = np.array([_ridge(np.delete(x[own], k, 0), np.delete(y[own], k, 0), 5.0, x[own][k], np.delete(weight, k), sd) for k in np.flatnonzero(target)])
        for t in (0, 1):
            assert got[0, t, w] == pytest.approx(_r(out, y[own][target])[t], abs=1e-9)
    some = df.withColumn("w", F.when(F.col("image_id") < 4, 0.0).otherwise(1.0))
    assert R.weighted_loo(some, 1.0).count() == 4 and R.weighted_loo(some.limit(0), 1.0).count() == 0


def test_refit_and_transfer_equal_plain_fits(spark, rows):
    df, x, y, g = rows
    penalties = spark.createDataFrame([(0, 0, 1.0), (0, 1, 50.0), (1, 0, 50.0), (1, 1, 1.0)], "grp long, target int, alpha double")
    got = {(r["image_id"], r["target"]): r["predicted"] for r in R.refit(df.where("image_id < 60"), penalties, df.where("image_id >= 60"), (1.0, 50.0)).collect()}
    moved = {(r["grp"], r["target"]): r["r"] for r in R.transfer(df, 1.0, "image_id < 60").collect()}
    for grp, alphas in ((0, (1.0, 50.0)), (1, (50.0, 1.0))):
        a, b = np.flatnonzero((g == grp) & (np.arange(90) < 60)), np.flatnonzero((g == grp) & (np.arange(90) >= 60))
        for t in (0, 1):
            want = _ridge(x[a], y[a], alphas[t], x[b])[:, t]
            assert [got[i, t] for i in b.tolist()] == pytest.approx(want.tolist())
            assert moved[grp, t] == pytest.approx(np.corrcoef(_ridge(x[a], y[a], 1.0, x[b])[:, t], y[b][:, t])[0, 1])


def test_ppca_equals_the_density_of_its_model(spark):
    rng = np.random.default_rng(4)
    ref = rng.normal(size=(200, 6)) * [5, 3, 1, 0.1, 0.1, 0.1] + 7
    new = rng.normal(size=(10, 6)) * 3 + 7
    as_rows = lambda a: spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(a)], "image_id long, v array<double>")
    got = [r["loglik"] for r in R.ppca_log_likelihood(as_rows(new), as_rows(ref)).orderBy("image_id").collect()]
    values, vectors = np.linalg.eigh(np.cov(ref.T))
    values, vectors = values[::-1], vectors[:, ::-1]
    k = int(np.searchsorted(np.cumsum(values) / values.sum(), 0.95)) + 1
    noise = values[k:].mean()
    cov = vectors[:, :k] * (values[:k] - noise) @ vectors[:, :k].T + noise * np.eye(6)
    z = new - ref.mean(axis=0)
    want = -0.5 * (6 * np.log(2 * np.pi) + np.linalg.slogdet(cov)[1] + np.einsum("nd,de,ne->n", z, np.linalg.inv(cov), z))
    assert got == pytest.approx(want.tolist())


def test_projection_keeps_distances_and_short_vectors(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(40, 400))
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)] + [(99, [1.0, 2.0]), (100, None)], "image_id long, v array<double>")
    out = {r["image_id"]: r["v"] for r in R.sparse_projection(df, ["image_id"], "v", 200, 1).collect()}
    again = {r["image_id"]: r["v"] for r in R.sparse_projection(df.repartition(7), ["image_id"], "v", 200, 1).collect()}
    assert out == again and out[99] == [1.0, 2.0] and out[100] is None
    ratio = [np.linalg.norm(np.subtract(out[i], out[j])) / np.linalg.norm(x[i] - x[j]) for i in range(10) for j in range(i)]
    assert 0.8 < min(ratio) and max(ratio) < 1.2


@pytest.mark.parametrize("name", ["kfold_penalties", "augmented_readout", "adapted_readout", "ppca_loglik", "projected_scores", "semantic_clusters"])
def test_registered_readouts_cover_their_groups(spark, tiny, name):
    got = catalog.queries()[name](spark, tiny).toPandas()
    n = spark.read.parquet(f"{tiny}/embeddings.parquet").count()
    if "image_id" in got:
        assert len(got) == n == got["image_id"].nunique() and not got.isna().any().any()
    else:
        assert got["grp"].nunique() == 10 and got["r"].between(-1, 1).all()


def test_a_teacher_is_recovered_by_its_own_features(spark):
    rng = np.random.default_rng(7)
    data = [(g, m, i, (rng.normal(size=4) * s).tolist()) for g in (0, 1) for m, s in (("a", 1.0), ("b", 1.0), ("c", 2.0)) for i in range(40)]
    f = spark.createDataFrame(data, "grp long, model string, image_id long, v array<double>")
    clean = R.teacher_student(f, 0.0, 1, 1e-9, "image_id % 2 = 0", "euclidean").toPandas()
    assert len(clean) == 2 * 3 * 3
    own = clean[clean["teacher"] == clean["student"]]
    assert np.allclose(own["r"], 1.0, atol=1e-6) and clean[clean["teacher"] != clean["student"]]["r"].abs().max() < 0.9
    noisy = R.teacher_student(f.repartition(5), 0.5, 3, 1.0, "image_id % 2 = 0", "euclidean", 1).toPandas()
    assert set(noisy["draw"]) == {0, 1, 2} and noisy[noisy["teacher"] == noisy["student"]]["r"].mean() < 0.99


def test_registered_recovery_names_a_winner_for_every_teacher(spark, tiny):
    got = catalog.queries()["teacher_student"](spark, tiny).toPandas()
    assert len(got) == 20 * 4 and got["winner"].between(0, 3).all()
    assert got["correct"].mean() > 0.5
