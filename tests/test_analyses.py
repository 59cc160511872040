"""Sequential and distributional operators against plain definitions."""

from __future__ import annotations

import itertools
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from prismal.functions import special as P
from prismal.operators import resampling as B, recovery as V, selection as L, tables as O
from prismal.plans import catalog


def test_greedy_matches_take_the_nearest_unused_row(spark):
    rng = np.random.default_rng(1)
    rows = [(g, k, float(x), float(y), bool(k % 4 == 0)) for g in ("a", "b") for k, (x, y) in enumerate(rng.normal(size=(25, 2)))]
    df = spark.createDataFrame(rows, "g string, k long, x double, y double, t boolean")
    got = {(r["g"], r["k"]): (r["match"], r["distance"]) for r in O.greedy_matches(df.where("t"), df.where("NOT t"), ["g"], "k", ["x", "y"]).collect()}
    for g in ("a", "b"):
        mine = [r for r in rows if r[0] == g]
        z = np.array([r[2:4] for r in mine])
        z = (z - z.mean(axis=0)) / z.std(axis=0)
        free = {r[1] for r in mine if not r[4]}
        own = sorted((r[1] for r in mine if r[4]), key=lambda k: (min(np.linalg.norm(z[k] - z[j]) for j in free), k))
        for k in own:
            j = min(sorted(free), key=lambda j: np.linalg.norm(z[k] - z[j]))
            free.remove(j)
            assert got[g, k][0] == j and got[g, k][1] == pytest.approx(np.linalg.norm(z[k] - z[j]))
    assert O.greedy_matches(df.where("t"), df.limit(0), ["g"], "k", ["x", "y"]).count() == 0


def test_registered_matches_are_one_to_one(spark, tiny):
    got = catalog.queries()["matched_parts"](spark, tiny).toPandas()
    assert len(got) and not got["match"].duplicated().any() and not got["p_partkey"].duplicated().any()


def test_capped_pairs_equal_a_plain_loop(spark, tiny):
    got = {tuple(r) for r in catalog.queries()["capped_pairs"](spark, tiny).select("subject", "key_a", "key_b").collect()}
    from prismal.plans.analyses import _means

    x = O.self_pairs(_means(spark, tiny), ["subject"], "model", "s").toPandas()
    want = set()
    for s, part in x.assign(gap=(-(x["a"] - x["b"]).abs()).round(9)).groupby("subject"):
        seen = {}
        for r in part.sort_values(["gap", "key_a", "key_b"]).itertuples():
            if seen.get(r.key_a, 0) < 2 and seen.get(r.key_b, 0) < 2:
                want.add((s, r.key_a, r.key_b))
                seen[r.key_a], seen[r.key_b] = seen.get(r.key_a, 0) + 1, seen.get(r.key_b, 0) + 1
    assert got == want


def test_signed_ranks_of_long_groups_are_near_normal(spark):
    rng = random.Random(3)
    rows = [("long", k, rng.gauss(0.4, 1)) for k in range(60)] + [("short", k, v) for k, v in enumerate([1.0, 2.0, -0.5, 0.0, None])]
    got = {r["g"]: r for r in B.signed_ranks(spark.createDataFrame(rows, "g string, k int, x double"), ["g"], "k", "x").collect()}
    x = np.array([r[2] for r in rows if r[0] == "long"])
    ranks = pd.Series(np.abs(x)).rank().to_numpy()
    null = np.random.default_rng(4).integers(0, 2, (200_000, len(x))) @ ranks
    w = ranks[x > 0].sum()
    assert got["long"]["w_pos"] == w
    assert got["long"]["p_wilcoxon"] == pytest.approx(np.mean(np.abs(null - ranks.sum() / 2) >= abs(w - ranks.sum() / 2)), rel=0.2, abs=2e-3)
    sums = [sum(r for r, s in zip([2, 3, 1], signs) if s) for signs in itertools.product((0, 1), repeat=3)]
    p = 2 * min(np.mean([s <= 5 for s in sums]), np.mean([s >= 5 for s in sums]))
    assert (got["short"]["n"], got["short"]["w_pos"]) == (3, 5.0) and got["short"]["p_wilcoxon"] == pytest.approx(min(1, p))


def test_monte_carlo_swaps_agree_with_all_swaps(spark, monkeypatch):
    rng = np.random.default_rng(5)
    rows = [(k, float(a), float(b)) for k, (a, b) in enumerate(np.exp(rng.normal([0.3, 0.0], 0.5, (10, 2))))]
    df = spark.createDataFrame(rows, "u int, a double, b double")
    exact = B.ratio_permutation(df, "u", "a", "b").first()
    monkeypatch.setattr(B, "EXHAUSTIVE", 4)
    drawn = B.ratio_permutation(df, "u", "a", "b", draws=4000).first()
    assert drawn["observed"] == pytest.approx(exact["observed"]) and drawn["p"] == pytest.approx(exact["p"], abs=0.03)


def test_t_quantiles_invert_the_tail(spark):
    df = spark.createDataFrame([(0.975, 4.0), (0.5, 7.0), (0.9, 30.0)], "p double, df double")
    got = [r[0] for r in df.select(P.t_quantile("p", "df")).collect()]
    assert got == pytest.approx([2.7764451, 0.0, 1.3104150], abs=1e-6)


def test_refinement_never_raises_agreement_and_keeps_optima(spark, tiny):
    from prismal.plans.kernels import features

    f = features(spark, tiny).where("image_id < 40")
    start = [0, 1, 2, 3]
    chosen, history = L.refine(f, start, passes=2)
    assert len(set(chosen)) == 4 and len(history) in (1, 2) and history == sorted(history, reverse=True)
    x = {(r["model"], r["image_id"]): np.array(r["v"]) for r in f.collect()}
    models = sorted({m for m, _ in x})

    def mean_r(images):
        unit = lambda v: v / np.linalg.norm(v)
        d = np.array([[1 - unit(x[m, i]) @ unit(x[m, j]) for i, j in itertools.combinations(sorted(images), 2)] for m in models])
        return np.corrcoef(d)[np.triu_indices(len(models), 1)].mean()

    assert history[-1] == pytest.approx(mean_r(chosen), abs=1e-6) and mean_r(chosen) <= mean_r(start)
    last = [c for c in chosen if c != chosen[-1]]
    assert mean_r(chosen) <= min(mean_r([*last, k]) for k in range(40) if k not in last) + 1e-9


def test_variants_and_completeness(spark):
    rows = [(0, 1, "greedy", 0.2), (0, 2, "pass1", 0.5), (0, 3, "final", 0.4)]
    df = spark.createDataFrame(rows, "place int, image_id long, stage string, score double")
    assert [L.variant(df, n).first()["image_id"] for n in ("greedy", "final", "best_raw")] == [1, 3, 2]
    with pytest.raises(ValueError):
        L.variant(df, "other")
    with pytest.raises(ValueError):
        V.assert_complete(df, "stage", 2)
    assert V.assert_complete(df, "stage", 1) is df
    assert O.histogram_entropy(df.withColumn("score", F.lit(1.0)), ["stage"], "score").count() == 0


def test_feature_noise_has_its_limits_and_no_partitions(spark, tiny):
    from prismal.operators import kernels as K, simulation as M
    from prismal.plans.kernels import features

    f = features(spark, tiny).where("image_id < 60")
    clean = {tuple(r)[:3]: r["r"] for r in K.agreement(K.distance_profile(f), "pearson").select("grp", "model_a", "model_b", "r").collect()}
    none = M.feature_noise_agreement(f, 0.0, 2).collect()
    assert all(r["r"] == pytest.approx(clean[r["grp"], r["model_a"], r["model_b"]], abs=1e-9) for r in none if clean[r["grp"], r["model_a"], r["model_b"]] is not None)
    a = M.feature_noise_agreement(f, 0.2, 2, seed=4).orderBy("grp", "draw", "model_a", "model_b").collect()
    b = M.feature_noise_agreement(f.repartition(5), 0.2, 2, seed=4).orderBy("grp", "draw", "model_a", "model_b").collect()
    assert [r["r"] for r in a] == pytest.approx([r["r"] for r in b], nan_ok=True) and len({r["r"] for r in a}) > 6
    z = M.normals(1, 2, np.arange(20_000, dtype=np.uint64), 3)
    assert abs(z.mean()) < 0.02 and abs(z.std() - 1) < 0.02 and abs(np.corrcoef(z.T)[0, 1]) < 0.03
    with pytest.raises(ValueError):
        M.expected_agreement(f, "analytic", 0.1, method="spearman")
    one, many = (M.expected_agreement(f, k, 0.01, 30).orderBy("grp").collect() for k in ("analytic", "profile"))
    assert np.nanmean([abs(x["r"] - y["r"]) for x, y in zip(one, many) if x["r"] is not None]) < 0.1


def test_kind_comparisons_adjust_their_parts(spark, tiny):
    got = catalog.queries()["kind_comparisons"](spark, tiny).toPandas()
    for _, part in got.groupby("kind"):
        part = part.sort_values(["p_wilcoxon", "model"])
        m = len(part)
        holm = np.minimum(1, np.maximum.accumulate(part["p_wilcoxon"].to_numpy() * (m - np.arange(m))))
        assert np.allclose(part["p_holm"], holm, atol=2e-5) and (part["q"] <= part["p_holm"] + 2e-5).all()


def test_index_lists_check_their_bounds(spark):
    from prismal.functions import scalar as S

    df = spark.createDataFrame([("1,3-5",), ("4-2",), ("7",)], "x string")
    assert [r[0] for r in df.select(S.index_list(F.col("x"))).collect()] == [[1, 3, 4, 5], [], [7]]
    with pytest.raises(Exception, match="index out of bounds"):
        df.select(S.index_list(F.col("x"), 7)).collect()
    assert S.stable_seed("a", 1) != S.stable_seed("a", 1, separator="\0") and 0 <= S.stable_seed("a", base=5) < 2**31 - 1
