from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from prismal.operators import cells as C, kernels as K, ranks
from prismal.plans import catalog


@pytest.mark.parametrize("block", [None, 8])
@pytest.mark.parametrize("method", ["average", "ordinal"])
def test_ranks_by_cell_equal_those_of_rows_of_pairs(spark, monkeypatch, block, method):
    monkeypatch.setattr(ranks, "RANGE", 40)  # several ranges of values
    monkeypatch.setattr(ranks, "SAMPLE", 12)
    monkeypatch.setattr(C, "PIECE", 70)
    rng = np.random.default_rng(4)
    v = {m: rng.integers(-2, 3, size=(26, 3)).astype(float) for m in "rab"}  # equal vectors and distances
    v["c"] = np.ones((26, 3))
    rows = [(g, m, 60 - 2 * i, [None, 1.0, 1.0] if (g, m, i) == (0, "a", 3) else v[m][i].tolist()) for g in (0, 1) for m in "rabc" for i in range(26 - 9 * g) if (m, i) != ("b", 5)]
    x = spark.createDataFrame([*rows, (2, "r", 0, [1.0]), (2, "a", 0, [1.0])], "grp long, model string, image_id long, v array<double>")
    key = lambda t: {(r["grp"], r["model_a"], r["model_b"]): (r["n"], r["r"]) for r in t.collect()}
    got, want = key(C.agreement(ranks.moments(x, "euclidean", method, block))), key(K.agreement(K.distance_profile(x, "euclidean"), "spearman", method))
    assert len(want) == 12 and got.keys() == want.keys()
    assert {k: (got[k], want[k]) for k in want if got[k] != pytest.approx(want[k], abs=1e-9)} == {}


def test_keys_are_in_the_order_of_the_numbers():
    d = np.array([-np.inf, -2.5, -1e-300, -0.0, 0.0, 1e-300, 1.0, np.inf, np.nan, 7.0])
    key = ranks._keys(d, np.arange(10) < 9)
    assert key[3] == key[4] and (np.diff(np.delete(key, 3)) > 0).all()
    assert (ranks._unpacked(ranks._packed(key)) == key).all()


def test_unknown_rank_method_raises(spark):
    with pytest.raises(ValueError):
        ranks.moments(spark.createDataFrame([(0, "a", 0, [1.0])], "grp long, model string, image_id long, v array<double>").withColumn("grp", F.col("grp")), "cosine", "x")


@pytest.mark.parametrize("name", ["rsa_scores", "rsa_ordinal"])
def test_rank_queries_make_no_rows_of_pairs(spark, tiny, monkeypatch, name):
    def rows(*_):
        raise AssertionError("rows of pairs")

    monkeypatch.setattr(K, "image_pairs", rows)
    assert catalog.queries()[name](spark, tiny).count() > 0
