from __future__ import annotations

import pytest
from pyspark.sql import types as T

DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType())])


@pytest.fixture(scope="session")
def docs(spark):
    """A documents table from texts, (id, text) or (id, text, lang)."""

    def make(rows):
        full = [(i, r, None) if isinstance(r, str) or r is None else (*r, *[None] * (3 - len(r))) for i, r in enumerate(rows)]
        return spark.createDataFrame(full, DOCS)

    return make
