from __future__ import annotations

import os
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))
os.environ["PYTHONPATH"] = os.pathsep.join(filter(None, [str(ROOT), os.environ.get("PYTHONPATH")]))


@pytest.fixture(scope="session")
def spark():
    from prismal.session import local_session

    session = local_session(8, 8)
    session.sparkContext.setLogLevel("ERROR")
    yield session


@pytest.fixture(scope="session")
def tiny() -> str:
    return "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def duck():
    """Runs SQL over the tables of a folder."""
    import duckdb

    tables = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

    def run(sql: str, folder: str):
        con = duckdb.connect()
        for t in tables:
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
        return con.execute(sql).df()

    return run


@pytest.fixture(scope="session")
def same_rows():
    """Compares two pandas frames as bags of rows."""
    import math
    import numbers

    import pandas as pd

    def cell(v):
        if isinstance(v, float):
            return None if math.isnan(v) else round(v, 5) + 0.0
        if v is None or v is pd.NaT or v is pd.NA:
            return None
        return round(float(v), 5) + 0.0 if isinstance(v, numbers.Number) and not isinstance(v, bool) else str(v)

    def key(row):  # names first, so that a last digit does not reorder rows
        return [repr(v) for v in row if not isinstance(v, float)], [v for v in row if isinstance(v, float)]

    def check(a, b):
        assert sorted(a.columns) == sorted(b.columns)
        cols = sorted(a.columns)
        rows = [sorted((tuple(map(cell, r)) for r in x[cols].itertuples(index=False, name=None)), key=key) for x in (a, b)]
        assert len(rows[0]) == len(rows[1])
        bad = [(x, y) for x, y in zip(*rows) if x != y and not all(p == q or (isinstance(p, float) and isinstance(q, float) and abs(p - q) < 3e-5) for p, q in zip(x, y))]
        assert not bad, bad[:3]

    return check
