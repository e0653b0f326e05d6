"""Plan-shape checks: the properties the scale design relies on, read from the physical plans."""

from __future__ import annotations

import datetime as dt
import uuid
from decimal import Decimal

import __spark_entry__ as se
from ledgerflow.session import work_dir
from ledgerflow import functions as lf
from ledgerflow.operators import metrics as m
from ledgerflow.sources.tables import load_tables

from __spark_entry__ import SMOKE_DIR

QS = se.queries()


def _plan(df) -> str:
    """The formatted physical plan (full scan metadata: PushedFilters, PartitionFilters)."""
    return df.sparkSession._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")


def test_period_filter_reaches_the_scan(spark):
    plan = _plan(QS["sales_today"](spark, SMOKE_DIR))
    assert "GreaterThanOrEqual(o_orderdate,2001-07-30T00:00)" in plan
    assert "LessThan(o_orderdate,2001-08-01T00:00)" in plan


def test_period_filter_with_zone_still_pushes(spark):
    orders = spark.createDataFrame([(1, "tln_db", dt.datetime(2001, 7, 30, 18), "sale", Decimal("5.00"))],
                                   "id bigint, db string, date_order timestamp_ntz, state string, "
                                   "amount_total decimal(18,2)")
    path = work_dir(spark, "tests", "tz-" + uuid.uuid4().hex) + "/o"
    orders.write.parquet(path)
    df = m.sales_summary(spark.read.parquet(path), dt.date(2001, 7, 31), tz="Asia/Jakarta")
    assert "GreaterThanOrEqual(date_order,2001-07-29T17:00)" in _plan(df)
    # 18:00 UTC on the 30th is 01:00 on the 31st in Jakarta
    assert {r.db: r.order_count for r in df.collect()}["tln_db"] == 1
    assert lf.local_midnight_utc(dt.date(2001, 7, 31), "Asia/Jakarta") == dt.datetime(2001, 7, 30, 17)


def test_top_k_is_limited_before_the_shuffle(spark):
    tree = QS["overdue_summary_capped"](spark, SMOKE_DIR)._jdf.queryExecution().executedPlan().toString()
    lines = tree.split("\n")
    final = next(i for i, x in enumerate(lines) if "WindowGroupLimit" in x and "Final" in x)
    partial = next(i for i, x in enumerate(lines) if "WindowGroupLimit" in x and "Partial" in x)
    exchanges = [i for i, x in enumerate(lines) if "Exchange hashpartitioning(db" in x]
    # tree order: Final above the company exchange, Partial below it (before the shuffle)
    assert any(final < e < partial for e in exchanges)


def test_dimension_lookups_do_not_shuffle_dimensions(spark):
    for name in ("top_products_today", "overdue_invoices", "pending_invoices"):
        plan = _plan(QS[name](spark, SMOKE_DIR))
        assert "SortMergeJoin" not in plan, name


def test_approval_fold_has_no_per_object_window(spark):
    plan = _plan(QS["invoice_approvals"](spark, SMOKE_DIR))
    assert "Window [" not in plan and "RunningWindowFunction" not in plan
    assert "LeftSemi" in plan  # the object table is cut to named objects first


def test_company_aggregates_are_partial(spark):
    plan = _plan(QS["customer_risk"](spark, SMOKE_DIR))
    assert "partial_sum" in plan


def test_load_tables_per_company_and_partitioned(spark):
    root = work_dir(spark, "tests", "load-" + uuid.uuid4().hex)
    a = spark.createDataFrame([(1, "x")], "id bigint, v string")
    b = spark.createDataFrame([(2, "y"), (3, "z")], "id bigint, v string")
    a.write.parquet(f"{root}/tln")
    b.write.parquet(f"{root}/ieg")
    out = load_tables(spark, {"t": [f"{root}/tln", f"{root}/ieg"]}, dbs=["tln_db", "ieg_db"])["t"]
    assert sorted((r.db, r.id) for r in out.collect()) == [("ieg_db", 2), ("ieg_db", 3), ("tln_db", 1)]
    part = spark.createDataFrame([(1, "tln_db"), (2, "hris_db")], "id bigint, db string")
    part.write.partitionBy("db").parquet(f"{root}/p")
    got = load_tables(spark, {"p": f"{root}/p"})["p"]
    assert [r.id for r in got.collect()] == [1]  # only allowed companies
    assert "PartitionFilters: [isnotnull(db" in _plan(got) or "PartitionFilters" in _plan(got)


def test_lookup_paths_agree(spark):
    """Size-checked broadcast of the dimension and the bounded path give the same rows."""
    names = ("top_products_today", "overdue_invoices", "pending_invoices", "invoice_detail")
    fast = {n: sorted(map(tuple, QS[n](spark, SMOKE_DIR).collect()), key=repr) for n in names}
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for n in names:
            df = QS[n](spark, SMOKE_DIR)
            assert sorted(map(tuple, df.collect()), key=repr) == fast[n], n
            if n != "invoice_detail":  # bounded inputs: the dimension is never shuffled
                assert "SortMergeJoin" not in _plan(df), n
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def test_company_table_layout_prunes_partitions_and_row_groups(spark):
    from ledgerflow.sources.fixtures import fixtures
    from ledgerflow.sources.tables import write_company_table

    path = work_dir(spark, "tests", "layout-" + uuid.uuid4().hex)
    write_company_table(fixtures(spark, SMOKE_DIR)["sale_order"], path, ["date_order"], files_per_company=4)
    table = load_tables(spark, {"so": path}, dbs=["ieg_db"])["so"]
    df = m.sales_summary(table, dt.date(2001, 7, 31), dbs=["ieg_db"])
    plan = _plan(df)
    assert "PartitionFilters: [isnotnull(db" in plan and "ieg_db" in plan
    assert "GreaterThanOrEqual(date_order,2001-07-30T00:00)" in plan
    assert df.filter("db = 'ieg_db'").first().order_count >= 0
