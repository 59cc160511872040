from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import Window, functions as F

from prismal.functions.aggregate import correlation
from prismal.operators import cells as C, disagreement as D, kernels as K
from prismal.plans import catalog


@pytest.fixture(scope="module")
def features(spark):
    """Three models of two groups: vectors of several lengths, nulls, copies, a constant model."""
    rng, rows = np.random.default_rng(3), []
    for g in range(2):
        for m in range(4):
            for i in range(23 - g):
                v = [1.0, 2.0, 4.0] if m == 3 else rng.normal(size=3 + m).tolist()
                if m == 0 and i == 5:
                    v = None
                if m == 1 and i == 6:
                    v[1] = None
                if m == 1 and i == 7:
                    v = v[:2]
                if not (m == 2 and i % 9 == 4):
                    rows.append((g, f"m{m}", 100 - 3 * i, v))
    return spark.createDataFrame(rows, "grp long, model string, image_id long, v array<double>").cache()


@pytest.fixture(params=[(7, 30), (2048, 1 << 18)])
def sizes(request, monkeypatch):
    monkeypatch.setattr(C, "BLOCK", request.param[0])
    monkeypatch.setattr(C, "PIECE", request.param[1])


def _near(got, want, keys):
    got, want = (x.orderBy(*keys).toPandas() for x in (got, want.select(got.columns)))
    assert len(got) == len(want) and len(got)
    for c in got.columns:
        if got[c].dtype.kind == "f":
            assert np.allclose(got[c], want[c].astype(float), atol=1e-9, equal_nan=True), c
        else:
            assert got[c].tolist() == want[c].tolist(), c


@pytest.mark.parametrize("metric", ["cosine_floor", "euclidean", "correlation"])
def test_moments_equal_those_of_rows_of_pairs(features, sizes, metric):
    p, m = K.distance_profile(features, metric), C.moments(features, metric)
    _near(C.agreement(m), K.agreement(p, "pearson"), ["grp", "model_a", "model_b"])
    want = p.groupBy("grp", "model").agg(F.count("*").alias("pairs"), F.count("d").alias("n"), F.avg("d").alias("mean"), F.var_pop("d").alias("var"), F.min("d").alias("low"), F.max("d").alias("high"))
    _near(C.profiles(m), want, ["grp", "model"])
    _near(D.noise_variance(C.profiles(m), 0.5), D.noise_variance(p, 0.5), ["grp"])


def test_disagreement_equals_that_of_rows_of_pairs(features, sizes):
    p = K.distance_profile(features, "euclidean")
    s = p.groupBy("grp", "model").agg(F.avg("d").alias("m"), (F.stddev_pop("d") + 1e-10).alias("s"))
    v = p.join(s, ["grp", "model"]).groupBy("grp", "i", "j").agg(F.var_pop((F.col("d") - F.col("m")) / F.col("s")).alias("v"))
    want = v.select("grp", F.explode(F.array("i", "j")).alias("image"), "v").groupBy("grp", "image").agg(F.avg("v").alias("disagreement"))
    _near(C.disagreement(features, "euclidean"), want, ["grp", "image"])


@pytest.mark.parametrize("bins, last", [(9, 20)])
def test_lower_median_equals_percentile_disc(features, sizes, monkeypatch, bins, last):
    monkeypatch.setattr(C, "BINS", bins)
    monkeypatch.setattr(C, "SORTED", last)
    p = K.distance_profile(features, "cosine").groupBy("model")
    bounds = p.agg(F.count("d").alias("n"), F.min(1 - F.col("d")).alias("low"), F.max(1 - F.col("d")).alias("high"))
    own = C.profiles(C.moments(features, "cosine")).groupBy("model").agg(F.sum("n").alias("n"), (1 - F.max("high")).alias("low"), (1 - F.min("low")).alias("high"))
    _near(own, bounds, ["model"])
    _near(C.lower_median(features, "cosine", own), p.agg(F.expr("percentile_disc(0.5) WITHIN GROUP (ORDER BY 1 - d)").alias("value")), ["model"])


def test_two_vectors_of_one_model_and_image_are_refused(features):
    with pytest.raises(Exception, match="several vectors"):
        C.moments(features.unionAll(features), "euclidean").collect()


def test_rows_of_pairs_equal_the_grouped_profile(features, monkeypatch):
    monkeypatch.setattr(C, "ROWS", 7)
    got = C.rows(features, "euclidean").select("grp", "i", "j", "models", "d").collect()
    want = K.pair_rows(K.distance_profile(features, "euclidean")).select("grp", "i", "j", "models", "d").collect()
    assert sorted(map(str, got)) == sorted(map(str, want)) and len(got) > 400


def test_chunked_cosine_equals_its_pairs(spark, features, sizes, same_rows):
    pairs = K.chunked_cosine(features, "model").groupBy("grp").agg(F.count("*").alias("n"), F.avg("d").alias("mean"))
    same_rows(C.chunked_cosine(features).toPandas(), pairs.toPandas())
    assert C.chunked_cosine(features.where("image_id = 100")).count() == 0


@pytest.mark.parametrize("metric", ["cosine_floor", "euclidean"])
def test_candidate_summary_equals_its_pairs(spark, features, sizes, same_rows, metric):
    f = features.where("grp = 0")
    chosen = f.where("image_id % 2 = 0")
    pairs = K.candidate_distances(f, chosen, metric).groupBy("model", "image").agg(F.count("*").alias("n"), F.min("d").alias("low"), F.avg("d").alias("mean"))
    same_rows(C.candidate_summary(f, chosen, metric).toPandas(), pairs.toPandas())
    assert C.candidate_summary(f, chosen.where("false"), metric).count() == 0


def test_pairs_of_whole_groups_are_not_shuffled(spark, features):
    for x in (C.chunked_cosine(features), C.candidate_summary(features, features.where("image_id % 2 = 0"))):
        assert "Join" not in x._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def no_rows(monkeypatch):
    def rows(*_):
        raise AssertionError("rows of pairs")

    for name in ("distance_profile", "image_pairs", "profile_pairs"):
        monkeypatch.setattr(K, name, rows)


def test_total_agreement_equals_that_of_rows_of_pairs(features, sizes):
    x = features.where("v IS NOT NULL AND NOT exists(v, x -> x IS NULL) AND NOT (model = 'm1' AND size(v) < 4)")
    x = x.unionByName(x.where("model = 'm3'").withColumn("model", F.lit("m4")))  # two constant models
    want = K.total_agreement(K.distance_profile(x, "euclidean"))
    _near(C.total_agreement(C.moments(x, "euclidean")), want, ["grp", "model_a", "model_b"])
    assert {r["r"] for r in want.where("model_a = 'm3' OR model_b = 'm3'").collect()} == {0.0, 1.0}


def test_total_agreement_query_makes_no_rows_of_pairs(spark, tiny, no_rows):
    assert catalog.queries()["total_agreement"](spark, tiny).count() > 0


def test_similarity_agreement_equals_that_of_rows_of_pairs(features, sizes):
    _near(C.agreement(C.similarity_moments(features)), K.agreement(K.similarity_profile(features), "pearson"), ["grp", "model_a", "model_b"])


def test_similarity_agreement_query_makes_no_rows_of_pairs(spark, tiny, no_rows):
    assert catalog.queries()["similarity_agreement"](spark, tiny).count() > 0


def test_score_pairs_equal_those_of_rows_of_pairs(features, sizes):
    w = Window.partitionBy("grp", "model")
    z = K.distance_profile(features, "euclidean").withColumn("z", (F.col("d") - F.avg("d").over(w)) / (F.stddev_pop("d").over(w) + 1e-10))
    x = z.where("model <> 'm1'").join(z.where("model = 'm1'").select("grp", "i", "j", F.col("z").alias("fixed")), ["grp", "i", "j"]).groupBy("grp", "model")
    want = x.agg(F.count("*").alias("n"), F.avg(F.when(F.col("fixed") > 1, F.col("z"))).alias("mean_far"), correlation(F.col("z"), F.col("fixed")).alias("r"))
    _near(C.score_pairs(features, "m1", "euclidean"), want, ["grp", "model"])
    assert C.score_pairs(features, "none").count() == 0


def test_score_pair_table_query_makes_no_rows_of_pairs(spark, tiny, no_rows):
    assert catalog.queries()["score_pair_table"](spark, tiny).count() > 0
