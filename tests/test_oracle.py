"""Every registered query against its DuckDB oracle on the smallest scale (rows, columns, values)."""

from __future__ import annotations

import os
import sys

import pytest

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "tools"))

import __spark_entry__ as se  # noqa: E402
from oracle_check import digest  # noqa: E402

from __spark_entry__ import SMOKE_DIR  # noqa: E402

ORACLES = se.oracle_sql()
QUERIES = {n: q for n, q in se.queries().items() if n in se.catalog.REGISTRY}  # tests/llm has the other ones


def test_every_query_has_an_oracle():
    assert set(QUERIES) <= set(ORACLES)


def test_entry_runs(spark):
    df = se.entry(spark)
    assert df.count() == 3
    assert "alerts_count" in df.columns


@pytest.mark.parametrize("name", sorted(n for n in QUERIES if not n.startswith("stream_")))
def test_query_matches_oracle(spark, duck, name):
    df = QUERIES[name](spark, SMOKE_DIR)
    rows = [tuple(r) for r in df.collect()]
    cur = duck.execute(ORACLES[name])
    ocols = [d[0] for d in cur.description]
    orows = cur.fetchall()
    assert sorted(df.columns) == sorted(ocols)
    assert len(rows) == len(orows)
    assert digest(df.columns, rows)[0] == digest(ocols, orows)[0]


def test_entry_schema_is_stable_and_names_are_plain(spark):
    import re

    assert se.entry(spark).schema == se.entry(spark).schema
    assert all(re.fullmatch(r"[a-z][a-z0-9_]*", n) for n in QUERIES)
    assert all(sql.lstrip().upper().startswith(("WITH", "SELECT")) for sql in ORACLES.values())
