"""Teacher recovery against an explicit fit for every teacher, level, draw, student and target."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from prismal.operators import teachers as T
from prismal.operators.simulation import normals
from prismal.plans import catalog

ALPHAS = [10.0, 0.1, 1.0]
PART = "CASE WHEN image_id % 4 < 2 THEN 'fit' WHEN image_id % 4 = 2 THEN 'val' WHEN image_id % 8 = 3 THEN 'e' ELSE 'f' END"


def _part(k):
    return "fit" if k % 4 < 2 else "val" if k % 4 == 2 else "e" if k % 8 == 3 else "f"


def _features(spark, n=48):
    rng = np.random.default_rng(1)
    base = rng.normal(size=(2, n, 6))
    data = {(g, m, k): (base[g, k] @ w)[: 3 + len(m)] + 0.3 * rng.normal(size=3 + len(m)) for g in range(2) for m, w in (("p", rng.normal(size=(6, 6))), ("qq", rng.normal(size=(6, 6)))) for k in range(n)}
    rows = [(g, m, k, v.tolist()) for (g, m, k), v in data.items()]
    return spark.createDataFrame([*rows, (0, "p", n + 1, [0.0] * 4)], "grp long, model string, image_id long, v array<double>"), data, n


def _distances(v, metric):
    i, j = np.triu_indices(len(v), 1)
    return np.linalg.norm(v[i] - v[j], axis=1)


def _pearson(a, b):
    return np.corrcoef(a, b)[0, 1]


@pytest.mark.parametrize("method", ["spearman"])
def test_recovery_equals_explicit_fits(spark, method):
    features, data, n = _features(spark)
    levels, draws = [0.04, 1.0], 2
    got = {tuple(r)[:-1]: r["r"] for r in T.teacher_recovery(features, F.expr(PART), levels, draws, ALPHAS, ("e", "f"), "euclidean", method, seed=5).collect()}
    assert len(got) == 2 * 2 * 2 * 2 * 2 * 2
    keys = {(r["grp"], r["image_id"]): r["key"] for r in features.select("grp", "image_id", F.xxhash64("grp", "image_id").alias("key")).distinct().collect()}
    rank = lambda x: np.argsort(np.argsort(x)) if method == "spearman" else x  # noqa: E731  (no ties)
    at = {p: [k for k in range(n) if _part(k) == p] for p in ("fit", "val", "e", "f")}
    for g in range(2):
        every = np.array([np.concatenate([data[g, m, k] for m in ("p", "qq")]) for k in range(n)])
        columns = {"p": slice(0, 4), "qq": slice(4, 9)}
        z = [normals(5, d, np.array([keys[g, k] for k in range(n)], np.int64).view(np.uint64), every.shape[1]) for d in range(draws)]
        for level, variance in enumerate(levels):
            for draw in range(draws):
                noisy = every + variance**0.5 * z[draw]
                for student, own in columns.items():
                    x = every[:, own]
                    m, s = x[at["fit"]].mean(0), x[at["fit"]].std(0)
                    x = (x - m) / np.where(s < 1e-6, 1, s)
                    for teacher, of in columns.items():
                        y = noisy[:, of]
                        fits = []
                        for a in sorted(ALPHAS):
                            w = np.linalg.solve(x[at["fit"]].T @ x[at["fit"]] + a * np.eye(x.shape[1]), x[at["fit"]].T @ (y[at["fit"]] - y[at["fit"]].mean(0)))
                            fits.append(x @ w + y[at["fit"]].mean(0))
                        score = [[_pearson(f[at["val"], t], y[at["val"], t]) for t in range(y.shape[1])] for f in fits]
                        best = np.argmax(score, axis=0)
                        out = np.stack([fits[b][:, t] for t, b in enumerate(best)], axis=1)
                        for p in ("e", "f"):
                            wanted = _pearson(rank(_distances(out[at[p]], "euclidean")), rank(_distances(y[at[p]], "euclidean")))
                            assert got[g, p, teacher, level, draw, student] == pytest.approx(wanted, abs=1e-9)


def test_noise_on_distances_and_rates(spark):
    features, data, n = _features(spark)
    clean = T.teacher_recovery(features, F.expr(PART), [0.0], 1, ALPHAS, ("e",), "euclidean").collect()
    same = T.teacher_recovery(features, F.expr(PART), [0.0], 1, ALPHAS, ("e",), "euclidean", profile_noise=[0.0]).collect()
    assert {tuple(r)[:-1]: round(r["r"], 9) for r in clean} == {tuple(r)[:-1]: round(r["r"], 9) for r in same}
    noisy = T.teacher_recovery(features.repartition(3), F.expr(PART), [0.0, 0.0], 2, ALPHAS, ("e",), "euclidean", "spearman", profile_noise=[0.0, 4.0]).toPandas()
    assert noisy[noisy.level == 0].r.mean() > noisy[noisy.level == 1].r.mean() and len(noisy) == 2 * 2 * 2 * 2 * 2
    with pytest.raises(ValueError):
        T.teacher_recovery(features, F.expr(PART), [0.0], 1, ALPHAS, profile_noise=[0.0, 1.0])
    cube = spark.createDataFrame(
        [(0, "e", "a", 0, 0, "a", 0.5), (0, "e", "a", 0, 0, "b", 0.5), (0, "e", "b", 0, 0, "a", 0.25), (0, "e", "b", 0, 0, "b", None), (0, "e", "b", 0, 1, "a", 0.25), (0, "e", "b", 0, 1, "b", 0.75)],
        "grp long, part string, teacher string, level int, draw int, student string, r double",
    )
    got = {r["teacher"]: (r["accuracy"], r["margin"], r["n"]) for r in T.recovery_rates(cube).collect()}
    assert got == {"a": (1.0, 0.0, 1), "b": (0.5, 0.5, 2)}


def test_registered_recovery(spark, tiny):
    rows = catalog.queries()["teacher_recovery"](spark, tiny).collect()
    assert len(rows) == len({(r["level"], r["teacher"]) for r in rows}) == 3 * 4
    own = {level: np.mean([r["accuracy"] for r in rows if r["level"] == level]) for level in range(3)}
    assert own[0] >= own[2] and own[0] > 0.9


def test_recovery_needs_no_row_for_each_pair(spark):
    features, *_ = _features(spark, 16)
    x = T.teacher_recovery(features, F.expr(PART), [0.0], 1, ALPHAS, ("e",), "euclidean")
    assert "Join" not in x._jdf.queryExecution().executedPlan().toString()
