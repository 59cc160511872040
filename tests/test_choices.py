"""Calibration, resampled images, selection over tracks and matched subsets: against plain versions."""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from prismal.operators import calibration, kernels, matching, rankboot, resampling, tracks
from prismal.operators.simulation import normals

N = 24


@pytest.fixture(scope="module")
def features(spark):
    rng = np.random.default_rng(1)
    v = {(t, m): rng.normal(size=(N, 4 + k)) for k, t in enumerate(("raw", "enc")) for m in "abc"}
    rows = [(t, m, i, v[t, m][i].tolist()) for (t, m) in v for i in range(N)]
    return v, spark.createDataFrame(rows, "track string, model string, image_id long, v array<double>")


def _fold(x, how, beta=5.0):
    return x.mean() if how == "mean" else x.min() if how == "min" else -np.log(np.exp(-beta * x).sum()) / beta


def _brute(v, start, size, noise, within, across, norm, aggregate, weights, power):
    chosen, out = list(start), []
    names = ("enc", "raw")
    while len(chosen) < size:
        pool = [c for c in range(N) if c not in chosen]
        raw = np.zeros((len(pool), 2))
        for k, t in enumerate(names):
            for row, c in enumerate(pool):
                i, j = np.triu_indices(len(chosen) + 1, 1)
                u = [x / (np.linalg.norm(x, axis=1, keepdims=True) + 1e-9) for x in (v[t, m][[*chosen, c]] for m in "abc")]
                d = np.array([(1 - x @ x.T)[i, j] for x in u])
                var = d.var(axis=1)
                r = np.corrcoef(d) * np.sqrt(var / (var + noise[t] + 1e-8))[:, None]
                raw[row, k] = _fold(np.array([r[m, m] - _fold(np.delete(r[m], m), within) for m in range(3)]), across)
        z = {"none": raw, "z": (raw - raw.mean(0)) / (raw.std(0) + 1e-6), "minmax": (raw - raw.min(0)) / (np.ptp(raw, axis=0) + 1e-6)}[norm]
        w = np.array([(weights or {}).get(n, 0.0 if weights and aggregate == "weighted_mean" else 1.0) for n in names])
        w = w / w.sum()
        if aggregate in tracks.FOLDS:
            s = np.array([_fold(x, aggregate) for x in z])
        else:
            s = z @ w if aggregate == "weighted_mean" else ((z - z.min() + 1) ** power @ w) ** (1 / power) - 1 + z.min()
        k = int(np.argmax(np.round(s, 12)))
        chosen.append(pool[k])
        out.append((len(chosen), pool[k], pytest.approx(s[k], abs=1e-9), dict(zip(names, pytest.approx(raw[k], abs=1e-9).expected))))
    return out


@pytest.mark.parametrize(
    "within, across, norm, aggregate, weights, power",
    [("mean", "mean", "none", "mean", None, 2.0), ("min", "smooth_min", "z", "smooth_min", None, 2.0), ("smooth_min", "min", "minmax", "weighted_mean", {"raw": 2.0, "enc": 1.0}, 2.0), ("mean", "mean", "z", "power_mean", {"raw": 3.0}, -1.0), ("mean", "min", "none", "min", None, 2.0)],
)
def test_selection_over_tracks_equals_brute_force_and_resumes(features, within, across, norm, aggregate, weights, power):
    v, df = features
    noise = {"raw": 0.02, "enc": 0.0}
    run = lambda size, start=None: tracks.select_tracks(df, size, start, 3, 3, noise, within, across, norm, aggregate, weights, power).collect()
    got = run(6)
    start = [r["image_id"] for r in got if r["stage"] == "start"]
    assert start == sorted(range(N), key=lambda i: hashlib.md5(f"3:{i}".encode()).hexdigest())[:3]
    want = _brute(v, start, 6, noise, within, across, norm, aggregate, weights, power)
    assert [(r["place"], r["image_id"], r["score"]) for r in got if r["stage"] == "greedy"] == [w[:3] for w in want]
    for r, w in zip([r for r in got if r["stage"] == "greedy"], want):
        assert r["scores"] == pytest.approx(w[3], abs=1e-9)
    assert [r["image_id"] for r in run(6, [r["image_id"] for r in got[:5]])] == [r["image_id"] for r in got]


def test_selection_over_tracks_refuses_what_it_cannot_do(features):
    _, df = features
    for bad in ({"aggregate": "identity"}, {"within": "max"}, {"start": [1]}, {"aggregate": "weighted_mean", "weights": {"other": 1.0}}):
        with pytest.raises(ValueError):
            tracks.select_tracks(df, 5, **{"start": [0, 1, 2], **bad})
    one = tracks.select_tracks(df.where("track = 'raw'"), 4, aggregate="identity").collect()
    assert len(one) == 4 and list(one[-1]["scores"]) == ["raw"]


def test_filtered_start_looks_at_few(spark):
    calls, order = [], sorted(range(1000), key=lambda i: (hashlib.md5(f"2:{i}".encode()).hexdigest(), i))
    pool = spark.range(1000).select(F.col("id").alias("image_id"))
    found, seen = tracks.filtered_start(pool, lambda b: (calls.append(b.count()), b.where("image_id % 7 = 0"))[1], 5, 16, 2)
    want = [i for i in order if i % 7 == 0][:5]
    assert found == want and seen == order.index(want[-1]) + 1 and sum(calls) <= seen + 16
    with pytest.raises(ValueError):
        tracks.filtered_start(pool.where("image_id < 20"), lambda b: b.where("image_id % 7 = 0"), 5, 4)


def test_profile_noise_equals_bisection_by_hand(spark, features):
    v, _ = features
    rows = [(g, m, i, v["raw", m][i].tolist()) for g in (0, 1) for m in "ab" for i in range(N) if i % 2 == g]
    profile = kernels.distance_profile(spark.createDataFrame(rows, "grp long, model string, image_id long, v array<double>"))
    keyed = profile.withColumn("key", F.xxhash64("grp", "i", "j")).toPandas()
    got = {(r["grp"], r["model"], r["level"]): r for r in calibration.profile_noise(profile, [0.9, 0.4, 1.0], 6, 1e-3).collect()}
    assert len(got) == 12 and all(r["reached"] for r in got.values())
    for (g, m, level), r in got.items():
        own = keyed[(keyed["grp"] == g) & (keyed["model"] == m)]
        d, z = own["d"].to_numpy(), [normals(0, k, own["key"].to_numpy().view(np.uint64), 1)[:, 0] for k in range(6)]
        mean = lambda x: np.mean([np.corrcoef(d + np.sqrt(x) * e, d)[0, 1] for e in z])
        assert abs(mean(r["noise"]) - level) < 1e-3 or level == 1.0
        assert r["r"] == pytest.approx(mean(r["noise"]) if level < 1 else 1.0, abs=1e-9)


def test_brackets_close_one_by_one(spark):
    b = spark.createDataFrame([("a", 0.5, 0.0, 1.0, True), ("b", 0.01, 0.0, 1.0, True), ("c", -1.0, 0.0, 1e5, True), ("d", 0.3, 0.0, 1.0, False), ("e", 0.5, 0.0, 1.0, True)], "key string, goal double, lo double, hi double, grow boolean")
    value = lambda p: p.select("key", F.when(F.col("key") != "e", F.exp(-F.col("x"))).alias("r"))
    got = {r["key"]: r for r in calibration.bisected(b, ["key"], value, 1e-2, 12).collect()}
    for k, goal in (("a", 0.5), ("b", 0.01)):
        assert got[k]["reached"] and got[k]["x"] == pytest.approx(-np.log(goal), abs=1.0)
    assert not got["c"]["reached"] and not got["e"]["reached"] and got["e"]["x"] is None
    assert not got["d"]["reached"] and got["d"]["x"] == pytest.approx(1.0, abs=1e-3)  # beyond its bracket


def test_feature_noise_reaches_its_levels(spark, features):
    v, _ = features
    rows = [(0, m, i, v["raw", m][i].tolist()) for m in "ab" for i in range(N)]
    x = spark.createDataFrame(rows, "grp long, model string, image_id long, v array<double>")
    got = calibration.feature_noise(x, [0.9, 0.6], draws=4).collect()
    keys = {(r["model"], r["image_id"]): r["k"] for r in x.select("model", "image_id", F.xxhash64("model", "image_id").alias("k")).collect()}
    i, j = np.triu_indices(N, 1)
    dist = lambda m: np.linalg.norm(m[i] - m[j], axis=1)
    for r in got:
        own, k = v["raw", r["model"]], np.array([keys[r["model"], n] for n in range(N)]).view(np.uint64)
        rs = [np.corrcoef(dist(own + r["sigma"] * normals(0, d, k, own.shape[1])), dist(own))[0, 1] for d in range(4)]
        assert r["reached"] and r["r"] == pytest.approx(np.mean(rs), abs=1e-9) and abs(np.mean(rs) - r["level"]) < 0.01


@pytest.mark.parametrize("method", ["spearman", "pearson"])
def test_stimulus_scores_equal_materialised_resamples(spark, method):
    rng, n = np.random.default_rng(2), 9
    d = {m: np.round(rng.random((n, n)), 1) for m in "rab"}  # ties, and zeros beside those of copies
    rows = [(0, m, i, j, float(d[m][i, j])) for m in d for i in range(n) for j in range(i + 1, n)]
    profile = spark.createDataFrame(rows, "grp long, model string, i long, j long, d double")
    got = {(r["draw"], r["model"]): r["r"] for r in resampling.stimulus_scores(profile, "r", 6, method, 5).collect()}
    full = {m: np.triu(x, 1) + np.triu(x, 1).T for m, x in d.items()}
    for k in range(6):
        idx = [int(hashlib.md5(f"5:{k}:{p}".encode()).hexdigest()[:8], 16) % n for p in range(n)]
        tri = np.triu_indices(n, 1)
        v = {m: x[np.ix_(idx, idx)][tri] for m, x in full.items()}
        for m in "ab":
            a, b = (pd.Series(v[x]).rank() if method == "spearman" else v[x] for x in (m, "r"))
            want = np.corrcoef(a, b)[0, 1]
            assert got[k, m] == pytest.approx(want, abs=1e-9)


def test_distribution_match_equals_the_plain_loop(spark, monkeypatch):
    rng = np.random.default_rng(4)
    for case in range(4):
        pool = [(g, i, float(np.round(rng.normal() * 3, 1 if case % 2 else 6))) for g in (0, 1) for i in range(300)] + [(0, 999, None), (1, 998, float("nan"))]
        wanted = [(g, float(np.round(rng.normal() + 2 * g, 1 if case % 2 else 6))) for g in (0, 1) for _ in range(40 + 250 * (case == 3))]
        df = spark.createDataFrame(pool, "grp long, image_id long, value double").repartition(7)
        got = {}
        for r in matching.distribution_match(df, spark.createDataFrame(wanted, "grp long, value double")).orderBy("grp", "rank").collect():
            got.setdefault(r["grp"], []).append((r["target"], r["image_id"], r["value"]))
        for g in (0, 1):
            left, want = {i: x for h, i, x in pool if h == g and x is not None and x == x}, []
            for t in sorted(x for h, x in wanted if h == g):
                i = min(left, key=lambda k: (abs(left[k] - t), left[k], k))
                want.append((t, i, left.pop(i)))
            assert got[g] == want
    monkeypatch.setattr(matching, "MOST_TARGETS", 3)
    with pytest.raises(ValueError):
        matching.distribution_match(df, spark.createDataFrame(wanted, "grp long, value double"))


@pytest.mark.parametrize("block", [None, 8])
def test_rank_scores_by_cell_equal_those_of_pairs(spark, monkeypatch, block):
    monkeypatch.setattr(rankboot, "STEP", 4)  # several ranges of values
    monkeypatch.setattr(rankboot, "STEPS", 2)
    monkeypatch.setattr(rankboot, "BATCH", 2)
    rng = np.random.default_rng(4)
    v = {m: rng.integers(-2, 3, size=(26, 3)).astype(float) for m in "rab"}  # equal vectors and distances
    rows = [(g, m, i, [None, 1.0, 1.0] if (g, m, i) == (0, "a", 3) else v[m][i].tolist()) for g in (0, 1) for m in "rab" for i in range(26 - 9 * g) if (m, i) != ("b", 5)]
    x = spark.createDataFrame([*rows, (2, "r", 0, [1.0]), (2, "a", 0, [1.0])], "grp long, model string, image_id long, v array<double>")
    key = lambda t: {(r["grp"], r["draw"], r["model"]): r["r"] for r in t.collect()}
    for metric in ("euclidean", "cosine"):
        got, want = key(rankboot.rank_scores(x, "r", 3, metric, 5, block)), key(resampling.stimulus_scores(kernels.distance_profile(x, metric), "r", 3, "spearman", 5))
        assert len(want) == 12 and got.keys() == want.keys()
        assert {k: (got[k], want[k]) for k in want if got[k] != pytest.approx(want[k], abs=1e-9)} == {}
        if metric == "euclidean":  # an image without distances, as a materialised resample has it
            full = {m: np.linalg.norm(v[m][:, None] - v[m][None], axis=2) for m in "ra"}
            full["a"][3] = full["a"][:, 3] = np.nan
            full["a"][3, 3] = 0.0
            for k in range(3):
                idx = [int(hashlib.md5(f"5:{k}:{p}".encode()).hexdigest()[:8], 16) % 26 for p in range(26)]
                a, r = (pd.Series(full[m][np.ix_(idx, idx)][np.triu_indices(26, 1)]).rank() for m in "ar")
                assert got[0, k, "a"] == pytest.approx(a.corr(r), abs=1e-9)


def test_rank_bootstrap_query_makes_no_rows_of_pairs(spark, tiny, monkeypatch):
    from prismal.plans import choices

    def rows(*_):
        raise AssertionError("rows of pairs")

    monkeypatch.setattr(choices.K, "distance_profile", rows)
    assert choices.stimulus_rank_bootstrap(spark, tiny).count() > 0


@pytest.mark.parametrize("metric", ["euclidean", "cosine"])
def test_pearson_scores_by_cell_equal_those_of_pairs(spark, monkeypatch, metric):
    monkeypatch.setattr(rankboot.cells, "BLOCK", 8)  # several cells and pieces
    monkeypatch.setattr(rankboot.cells, "PIECE", 40)
    rng = np.random.default_rng(6)
    rows = [(g, m, i, [None, 1.0, 1.0] if (g, m, i) == (0, "a", 3) else rng.normal(size=3).tolist()) for g in (0, 1) for m in "rab" for i in range(26 - 9 * g) if (m, i) != ("b", 5)]
    rows += [(3, m, i, [float("nan"), 1.0] if (m, i) == ("a", 2) else rng.normal(size=2).tolist()) for m in "ra" for i in range(9)]
    x = spark.createDataFrame([*rows, (2, "r", 0, [1.0]), (2, "a", 0, [1.0])], "grp long, model string, image_id long, v array<double>")
    key = lambda t: {(r["grp"], r["draw"], r["model"]): r["r"] for r in t.collect()}
    got, want = key(rankboot.pearson_scores(x, "r", 3, metric, 5)), key(resampling.stimulus_scores(kernels.distance_profile(x, metric), "r", 3, "pearson", 5))
    assert len(want) == 15 and got.keys() == want.keys()
    assert {k: (got[k], want[k]) for k in want if got[k] != pytest.approx(want[k], abs=1e-9, nan_ok=True)} == {}


def test_bootstrap_query_makes_no_rows_of_pairs(spark, tiny, monkeypatch):
    from prismal.plans import choices

    def rows(*_):
        raise AssertionError("rows of pairs")

    monkeypatch.setattr(choices.K, "distance_profile", rows)
    assert choices.stimulus_bootstrap(spark, tiny).count() > 0
