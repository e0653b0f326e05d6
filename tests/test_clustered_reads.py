"""Point reads by a table of ids from tables stored in the order of the id."""

from __future__ import annotations

import random
import uuid

import pytest
from pyspark.sql import functions as F

from __spark_entry__ import SMOKE_DIR
from ledgerflow.operators import lists as ls
from ledgerflow.session import work_dir
from ledgerflow.sources.fixtures import fixtures
from ledgerflow.sources.tables import load_tables, write_company_table
from test_audit_layout import scanned_rows


@pytest.fixture(scope="module")
def moves(spark):
    path = work_dir(spark, "tests", "moves-" + uuid.uuid4().hex)
    write_company_table(fixtures(spark, SMOKE_DIR)["account_move"], path, ["id"], files_per_company=8)
    return load_tables(spark, {"m": path})["m"]


def test_ranges_of_ids_reach_the_scan_and_skip_files(spark, moves):
    lowest, highest = moves.agg(F.min("id"), F.max("id")).first()
    ids = spark.createDataFrame([(lowest,), (lowest + 1,), (highest,), (None,), (highest + 10**6,)], "id bigint")
    df = ls.read_records(moves, ids, ["name"], clustered=True)
    plan = spark._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")
    assert "GreaterThanOrEqual(id" in plan and "LessThanOrEqual(id" in plan
    want = ls.read_records(moves, ids, ["name"])
    assert scanned_rows(df) < moves.count() / 3 < scanned_rows(want)
    assert sorted(map(tuple, df.collect())) == sorted(map(tuple, want.collect())) and df.count() >= 2


def test_ranges_hold_every_id(spark):
    rng = random.Random(8)
    for n, ranges in ((1, 32), (400, 4)):
        ids = [rng.choice([rng.randrange(100), 10**6 + rng.randrange(50), rng.randrange(-2**62, 2**62)]) for _ in range(n)]
        df = spark.createDataFrame([(i,) for i in ids], "id bigint")
        assert df.where(ls.id_ranges(df, "id", ranges)).count() == n


@pytest.mark.parametrize("names", [["SO00000007"], ["A", "ZZZ"], []])
def test_names_and_no_ids(spark, moves, names):
    table = moves.withColumn("name", F.concat(F.lit("SO"), F.lpad(F.col("id").cast("string"), 8, "0")))
    ids = spark.createDataFrame([(n,) for n in names], "name string")
    got = ls.get_doc(table, ids, ["id"], clustered=True)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, ls.get_doc(table, ids, ["id"]).collect()))


def test_company_and_id(spark, moves):
    ids = moves.where("id % 97 = 3").select("db", "id")
    got = ls.read_records(moves, ids, ["name"], clustered=True)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, moves.where("id % 97 = 3").select("db", "id", "name").collect()))


def test_invoice_context_never_broadcasts_unbounded_rows(spark, monkeypatch):
    from ledgerflow.operators import worklists as wl
    from ledgerflow.operators import topk
    from ledgerflow.operators.topk import lookup

    fx = fixtures(spark, SMOKE_DIR)
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        df = wl.invoice_context(fx["account_move"], fx["res_partner"], "2001-07-31")
        plan = spark._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")
        assert "BroadcastExchange" not in plan
        few = wl.invoice_context(fx["account_move"], fx["res_partner"], "2001-07-31", ids=[1, 2, 3, 4, 5, 6, 7])
        assert "SortMergeJoin" not in spark._jvm.PythonSQLUtils.explainString(few._jdf.queryExecution(), "formatted")
        monkeypatch.setattr(topk, "BOUND_ROWS", 10)
        many = wl.invoice_context(fx["account_move"], fx["res_partner"], "2001-07-31", ids=[1, 2, 3, 4, 5, 6, 7])
        assert "BroadcastExchange" not in spark._jvm.PythonSQLUtils.explainString(many._jdf.queryExecution(), "formatted")
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    with pytest.raises(TypeError):
        lookup(fx["account_move"], fx["res_partner"], ("partner_id", "id"), {"name": "n"}, True)
