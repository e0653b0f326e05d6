from __future__ import annotations

import pytest

from llm_helpers import EDGE_DOCS


@pytest.fixture(scope="session")
def edge(spark):
    """The edge rows with columns whose names clash with those that operators use inside."""
    df = spark.createDataFrame(EDGE_DOCS, "doc_id long, text string, source string")
    for name in ("score", "_id", "quality", "block", "c0", "kept", "n", "id", "_text", "_lane", "payload"):
        df = df.withColumn(name, df.source)
    return df


@pytest.fixture(scope="session")
def none(edge):
    return edge.limit(0)


@pytest.fixture(scope="session")
def small(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
