"""Every registered query against its SQL, on the smallest tables."""

from __future__ import annotations

import pytest

from prismal.operators import cells as C, kernels as K
from prismal.plans import catalog

SQL = catalog.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, tiny, duck, same_rows, name):
    same_rows(catalog.queries()[name](spark, tiny).toPandas(), duck(SQL[name], tiny))


def test_entry_imports_and_runs(spark):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert e.entry(spark).count() > 0


def test_queries_need_no_session_to_be_listed():
    import subprocess
    import sys
    from pathlib import Path

    root = Path(__file__).resolve().parents[1]
    subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; e.queries(), e.oracle_sql()"], check=True, cwd=root)


@pytest.mark.parametrize(
    "name",
    "attenuated_scores blocked_folds noise_sweep profile_correlation profile_correlation_safe profile_correlation_scaled profile_cosine profile_cosine_floor profile_euclidean rsa_ordinal rsa_pearson rsa_scores".split(),
)
def test_groups_of_several_blocks_match_sql(spark, tiny, duck, same_rows, monkeypatch, name):
    monkeypatch.setattr(K, "BLOCK", 20)
    monkeypatch.setattr(C, "BLOCK", 20)
    same_rows(catalog.queries()[name](spark, tiny).toPandas(), duck(SQL[name], tiny))
