"""Hand-made rows at every boundary the fixtures do not reach (risk, priority, comparison, thresholds)."""

from __future__ import annotations

import datetime as dt
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from ledgerflow import functions as lf
from ledgerflow.operators import lists as ls
from ledgerflow.operators import metrics as m
from ledgerflow.operators import worklists as wl

AS_OF = dt.date(2001, 7, 31)
MOVE_SCHEMA = ("id bigint, db string, name string, state string, move_type string, amount_total decimal(18,2), "
               "amount_residual decimal(18,2), partner_id bigint, currency_id int, date date, invoice_date date, "
               "invoice_date_due date, create_date timestamp_ntz")


def _move(i, due=None, state="posted", residual="1000.00", total=None, partner=1, create=None, db="tln_db",
          move_type="out_invoice", name=None):
    res = Decimal(residual)
    return (i, db, name if name is not None else f"INV/{i}", state, move_type, Decimal(total) if total else res, res,
            partner, 1, None, None, due, create)


def _moves(spark, rows):
    return spark.createDataFrame(rows, MOVE_SCHEMA)


def test_signed_percent_and_comparison(spark):
    df = spark.createDataFrame([(0.0, 0.0), (5.0, 0.0), (90.4, 100.0), (99.7, 100.0), (112.5, 100.0),
                                (113.5, 100.0), (50.0, 100.0)], "cur double, prev double")
    got = [r[0] for r in df.select(lf.change_text("cur", "prev")).collect()]
    assert got == ["N/A", "+∞", "-10%", "-0%", "+12%", "+14%", "-50%"]


def test_rupiah_half_even(spark):
    df = spark.createDataFrame([(2500000.5,), (3500000.5,), (1234567.49,), (0.0,)], "x double")
    assert [r[0] for r in df.select(lf.rupiah("x")).collect()] == ["2,500,000", "3,500,000", "1,234,567", "0"]


def test_risk_boundaries(spark):
    partners = spark.createDataFrame([(i, f"P{i}") for i in range(1, 7)], "id bigint, name string")
    d = AS_OF - dt.timedelta(days=1)
    rows = [
        _move(1, d, residual="100000000.00"),            # exactly 100M: not high, medium
        _move(2, d, residual="100000000.01", partner=2),  # just above: high
        *[_move(10 + k, d, residual="1.00", partner=3) for k in range(5)],   # 5 overdue: medium
        *[_move(20 + k, d, residual="1.00", partner=4) for k in range(6)],   # 6 overdue: high
        *[_move(30 + k, d, residual="1.00", partner=5) for k in range(2)],   # 2 overdue: low
        _move(40, AS_OF, residual="999999999.00", partner=5),                # due today: not overdue
    ]
    out = {(r.db, r.customer_id): r for r in m.customer_risk(_moves(spark, rows), partners, AS_OF).collect()}
    assert len(out) == 18  # 6 partners x 3 companies
    assert out[("tln_db", 1)].risk_score == "medium"
    assert out[("tln_db", 2)].risk_score == "high"
    assert out[("tln_db", 3)].risk_score == "medium"
    assert out[("tln_db", 4)].risk_score == "high"
    assert out[("tln_db", 5)].risk_score == "low"
    assert out[("tln_db", 5)].total_receivable == pytest.approx(999999999.0 + 2.0)
    assert out[("tln_db", 6)].overdue_count == 0 and out[("tln_db", 6)].risk_score == "low"
    assert out[("ieg_db", 1)].total_receivable == 0.0


@pytest.mark.parametrize("days,amount,expected", [
    (3, "1.00", "low"), (4, "1.00", "medium"), (7, "1.00", "medium"), (8, "1.00", "high"),
    (0, "50000000.00", "low"), (0, "50000000.01", "medium"), (0, "100000000.00", "medium"),
    (0, "100000000.01", "high"),
])
def test_pending_priority(spark, days, amount, expected):
    create = dt.datetime.combine(AS_OF - dt.timedelta(days=days), dt.time(10, 0))
    rows = [_move(1, None, state="draft", residual=amount, create=create)]
    r = wl.pending_approvals(_moves(spark, rows), AS_OF).collect()
    assert len(r) == 1 and r[0].days_pending == days and r[0].priority == expected


def test_pending_null_create_date_counts_as_today(spark):
    rows = [_move(1, None, state="draft", create=None), _move(2, None, state="draft",
                                                             create=dt.datetime(2001, 7, 1))]
    r = wl.pending_approvals(_moves(spark, rows), AS_OF, limit=1).collect()
    # PostgreSQL sorts NULL first in DESC order: the null-date draft is the newest
    assert len(r) == 1 and r[0].object_id == "1" and r[0].days_pending == 0


@pytest.mark.parametrize("days,amount,expected", [
    (15, "1.00", "high"), (30, "1.00", "high"), (31, "1.00", "critical"),
    (15, "100000000.01", "critical"), (15, "50000000.01", "high"),
])
def test_overdue_priority(spark, days, amount, expected):
    rows = [_move(1, AS_OF - dt.timedelta(days=days), residual=amount)]
    r = wl.overdue_items(_moves(spark, rows), AS_OF).collect()
    assert len(r) == 1 and r[0].priority == expected


def test_overdue_priority_lower_tiers(spark):
    # medium/low tiers need a threshold below 14 days
    rows = [_move(1, AS_OF - dt.timedelta(days=8)), _move(2, AS_OF - dt.timedelta(days=7)),
            _move(3, AS_OF - dt.timedelta(days=1))]
    r = {x.object_id: x.priority for x in wl.overdue_items(_moves(spark, rows), AS_OF, threshold_days=0).collect()}
    assert r == {"1": "medium", "2": "low", "3": "low"}


def test_overdue_threshold_is_strict_and_null_due_drops(spark):
    rows = [_move(1, AS_OF - dt.timedelta(days=14)), _move(2, AS_OF - dt.timedelta(days=15)), _move(3, None),
            _move(4, AS_OF - dt.timedelta(days=40), move_type="out_refund"),
            _move(5, AS_OF - dt.timedelta(days=40), move_type="in_invoice"),
            _move(6, AS_OF - dt.timedelta(days=40), state="draft"),
            _move(7, AS_OF - dt.timedelta(days=40), residual="0.00")]
    partners = spark.createDataFrame([(2, "Two")], "id bigint, name string")
    cur = spark.createDataFrame([(1, "")], "id int, symbol string")
    r = {x.id: x for x in ls.overdue_invoices(_moves(spark, rows), partners, cur, AS_OF, threshold_days=14).collect()}
    assert set(r) == {2, 4}
    assert r[2].days_overdue == 15 and r[4].days_overdue == 40
    assert r[4].partner_name == "Unknown"
    assert r[2].currency == "IDR"  # empty symbol falls back


def test_overdue_unknown_partner(spark):
    rows = [_move(1, AS_OF - dt.timedelta(days=3), partner=99)]
    partners = spark.createDataFrame([(1, "One")], "id bigint, name string")
    cur = spark.createDataFrame([(1, "Rp")], "id int, symbol string")
    r = ls.overdue_invoices(_moves(spark, rows), partners, cur, AS_OF).collect()
    assert r[0].partner_name == "Unknown" and r[0].currency == "Rp"


def test_company_without_orders_reports_zero(spark):
    orders = spark.createDataFrame(
        [(1, "tln_db", dt.datetime(2001, 7, 31, 9), "sale", Decimal("10.00")),
         (2, "tln_db", dt.datetime(2001, 7, 30, 9), "done", Decimal("40.00"))],
        "id bigint, db string, date_order timestamp_ntz, state string, amount_total decimal(18,2)")
    out = {r.db: r for r in m.sales_summary(orders, AS_OF).collect()}
    assert set(out) == {"tln_db", "ieg_db", "tmi_db"}
    assert out["tln_db"].comparison_previous == "-75%"
    assert out["ieg_db"].order_count == 0 and out["ieg_db"].avg_order_value == 0.0
    assert out["ieg_db"].comparison_previous == "N/A"


def test_mtd_counts_the_whole_month(spark):
    orders = spark.createDataFrame(
        [(1, "tln_db", dt.datetime(2001, 7, 1), "sale", Decimal("1.00")),
         (2, "tln_db", dt.datetime(2001, 7, 31, 23, 59), "done", Decimal("2.00")),
         (3, "tln_db", dt.datetime(2001, 8, 1), "done", Decimal("4.00")),
         (4, "tln_db", dt.datetime(2001, 7, 15), "draft", Decimal("8.00"))],
        "id bigint, db string, date_order timestamp_ntz, state string, amount_total decimal(18,2)")
    r = {x.db: x for x in m.sales_summary(orders, dt.date(2001, 7, 10), "mtd").collect()}
    assert r["tln_db"].order_count == 2 and r["tln_db"].total_revenue == 3.0


def test_unknown_company_is_refused(spark):
    with pytest.raises(ValueError):
        m.pending_orders(spark.createDataFrame([], "db string, state string"), dbs=["hris_db"])


def test_time_helpers(spark):
    df = spark.createDataFrame([(dt.datetime(2024, 1, 1, 20, 30),)], "ts timestamp_ntz")
    r = df.select(lf.to_local("ts").alias("loc"), lf.to_utc("ts").alias("utc"), lf.format_date("ts").alias("d"),
                  lf.format_datetime("ts").alias("dt"), lf.start_of_day("ts").alias("s"),
                  lf.end_of_day("ts").alias("e"), lf.days_between("ts", dt.date(2024, 1, 3)).alias("n")).first()
    assert r.loc == dt.datetime(2024, 1, 2, 3, 30)
    assert r.utc == dt.datetime(2024, 1, 1, 13, 30)
    assert r.d == "2024-01-02" and r.dt == "2024-01-02 03:30:00"
    assert r.s == dt.datetime(2024, 1, 1) and r.e == dt.datetime(2024, 1, 1, 23, 59, 59, 999999)
    assert r.n == 2


def test_invoice_context_actions(spark):
    rows = [_move(1, AS_OF - dt.timedelta(days=5), state="draft"), _move(2, AS_OF - dt.timedelta(days=5)),
            _move(3, AS_OF + dt.timedelta(days=5)), _move(4, None, state="cancel"), _move(5, None, state="weird",
                                                                                      name=None)]
    partners = spark.createDataFrame([(1, "One")], "id bigint, name string")
    r = {x.object_id: x for x in wl.invoice_context(_moves(spark, rows), partners, AS_OF).collect()}
    assert r["1"].available_actions == ["approve", "reject", "view"] and r["1"].requires_role == "manager"
    assert r["1"].days_overdue == 0
    assert r["2"].available_actions == ["view"] and r["2"].days_overdue == 5
    assert r["3"].days_overdue == 0
    assert r["4"].available_actions == ["view"]
    assert r["5"].available_actions == [] and r["5"].requires_role is None


def test_filters_and_paging(spark):
    df = spark.createDataFrame([(f"N{i:02d}", i % 3, None if i == 5 else f"S{i % 2}", i) for i in range(20)],
                               "name string, grp int, status string, v int")
    got = ls.list_query(df, [["v", ">=", 5], ["v", "<", 15], ["status", "!=", "S0"]], ["name"], "v desc", 2, 3)
    assert [r.name for r in got.collect()] == ["N09", "N07", "N05"]
    assert ls.count_query(df, {"grp": ["in", [0, 1]], "name": ["not like", "n1%"]}).first()[0] == 7
    assert ls.get_doc(df, "missing").count() == 0
    assert ls.search(df, {"grp": 2}, limit=0).count() == 6
    with pytest.raises(ValueError):
        ls.predicate("v", "between", 1)


def test_search_customers_case_switch(spark):
    cust = spark.createDataFrame([("C1", "Acme Corp", "g", "t"), ("C2", "ACME ltd", "g", "t")],
                                 "name string, customer_name string, customer_group string, territory string")
    assert ls.search_customers(cust, "acme").count() == 2
    assert ls.search_customers(cust, "acme", case_insensitive=False).count() == 0
    assert ls.search_customers(cust, "Acme", case_insensitive=False).count() == 1
    assert ls.list_query(cust, [["customer_name", "ilike", "%acme%"]], case_insensitive_like=False).count() == 2
    assert ls.list_query(cust, [["customer_name", "not ilike", "%ltd"]], case_insensitive_like=False).count() == 1


def test_digest_alert_rules(spark):
    from ledgerflow.operators import digests as dg

    orders = spark.createDataFrame(
        [(1, "tln_db", dt.datetime(2001, 7, 31, 9), "sale", Decimal("90.40")),
         (2, "tln_db", dt.datetime(2001, 7, 30, 9), "done", Decimal("100.00")),
         (3, "ieg_db", dt.datetime(2001, 7, 31, 9), "sale", Decimal("99.70")),
         (4, "ieg_db", dt.datetime(2001, 7, 30, 9), "done", Decimal("100.00")),
         (5, "tmi_db", dt.datetime(2001, 7, 1, 9), "draft", Decimal("1.00"))],
        "id bigint, db string, date_order timestamp_ntz, state string, amount_total decimal(18,2)")
    lines = spark.createDataFrame([], "order_id bigint, db string, product_id bigint, product_uom_qty decimal(18,2), "
                                      "price_subtotal decimal(18,2)")
    prods = spark.createDataFrame([], "id bigint, default_code string, product_tmpl_id bigint")
    tmpls = spark.createDataFrame([], "id bigint, name string")
    d = {r.db: r for r in dg.sales_digest(orders, lines, prods, tmpls, AS_OF).collect()}
    assert [a.message for a in d["tln_db"].alerts] == ["Sales down -10% vs yesterday"]
    assert d["ieg_db"].alerts == []  # -0% is not a drop
    assert [(a.type, a.message) for a in d["tmi_db"].alerts] == [("warning", "No orders today"),
                                                                 ("info", "1 orders pending confirmation")]
    assert d["tmi_db"].top_products == []
    fin = {r.db: r for r in dg.finance_digest(_moves(spark, [
        _move(1, AS_OF - dt.timedelta(days=31), residual="1500000.50"),
        _move(2, AS_OF - dt.timedelta(days=30), residual="1.00")]), AS_OF).collect()}
    assert [a.message for a in fin["tln_db"].alerts] == ["2 invoices overdue (Rp 1,500,002)",
                                                         "1 invoices >30 days overdue (Rp 1,500,000)"]
    assert fin["ieg_db"].alerts == []


def test_bounded_lookup_keeps_unmatched(spark):
    from ledgerflow.operators.topk import bounded_lookup

    small = spark.createDataFrame([(1,), (2,), (None,)], "k bigint")
    dim = spark.createDataFrame([(1, "a"), (3, "c")], "id bigint, v string")
    got = sorted(bounded_lookup(small, dim, ("k", "id"), {"v": "v"}).collect(), key=lambda r: (r.k is None, r.k))
    assert [(r.k, r.v) for r in got] == [(1, "a"), (2, None), (None, None)]


def test_deep_and_open_ended_pages_match_shallow_paging(spark):
    from ledgerflow.operators import topk

    df = spark.createDataFrame([(f"N{i:05d}", i % 7) for i in range(300)], "name string, v int")
    order = [F.col("v").desc(), F.col("name").asc()]
    everything = [r.name for r in df.orderBy(*order).collect()]
    assert [r.name for r in topk.top_k(df, order, None, 250).collect()] == everything[250:]
    old = topk.DEEP_PAGE
    topk.DEEP_PAGE = 10
    try:
        assert [r.name for r in topk.top_k(df, order, 20, 100).collect()] == everything[100:120]
    finally:
        topk.DEEP_PAGE = old
    assert [r.name for r in topk.top_k(df, order, 20, 100).collect()] == everything[100:120]


def test_parameter_variants(spark):
    from ledgerflow.sources.fixtures import fixtures

    from __spark_entry__ import SMOKE_DIR

    fx = fixtures(spark, SMOKE_DIR)
    cmp_ = {r.db: r for r in m.sales_comparison(fx["sale_order"], AS_OF, period="week").collect()}
    assert {r.comparison for r in cmp_.values()} == {"N/A"} and len(cmp_) == 3
    some = [r.id for r in fx["res_partner"].limit(3).collect()]
    risk = m.customer_risk(fx["account_move"], fx["res_partner"], AS_OF, customer_ids=some)
    assert sorted({r.customer_id for r in risk.collect()}) == sorted(some) and risk.count() == 9
    risk_df = m.customer_risk(fx["account_move"], fx["res_partner"], AS_OF,
                              customer_ids=spark.createDataFrame([(some[0],)], "id bigint"))
    assert risk_df.count() == 3
    ids = [r.id for r in fx["account_move"].limit(4).collect()]
    det = ls.invoice_detail(fx["account_move"], fx["res_partner"], fx["res_currency"], ids=ids)
    assert sorted(r.id for r in det.collect()) == sorted(ids)
    ctx = wl.invoice_context(fx["account_move"], fx["res_partner"], AS_OF, ids=ids[:2])
    assert ctx.count() == 2
    rec = ls.read_records(fx["hr_expense"], [r.id for r in fx["hr_expense"].limit(2).collect()], ["name"])
    assert rec.columns == ["db", "id", "name"] and rec.count() == 2
    with pytest.raises(ValueError):
        m.overdue_summary(fx["account_move"], AS_OF, threshold_days=-1)


def test_the_allowed_companies_can_be_set(spark):
    from ledgerflow.operators import metrics
    from ledgerflow.sources import tables

    pickings = spark.createDataFrame([("hris_db", "assigned"), ("tln_db", "confirmed"), ("other", "assigned")],
                                     "db string, state string")
    try:
        assert tables.set_companies(" tln_db, ieg_db,tmi_db , hris_db,") == ("tln_db", "ieg_db", "tmi_db", "hris_db")
        got = {r.db: r.pending_deliveries for r in metrics.pending_deliveries(pickings).collect()}
        assert got == {"tln_db": 1, "ieg_db": 0, "tmi_db": 0, "hris_db": 1}
        with pytest.raises(ValueError):
            tables.check_companies(["other"])
        with pytest.raises(ValueError):
            tables.set_companies(" , ")
    finally:
        assert tables.set_companies() == tables.COMPANIES
    with pytest.raises(ValueError):
        tables.check_companies(["hris_db"])


def test_null_rows_and_backslashes_in_filters(spark):
    from ledgerflow.operators.lists import list_query, predicate

    df = spark.createDataFrame([(1, "a\\b"), (2, None), (3, "ab"), (4, "a%b")], "name int, v string")
    def names(op, value):
        return sorted(r.name for r in df.filter(predicate("v", op, value)).collect())
    assert names("!=", "ab") == [1, 2, 4] and names("not in", ["ab"]) == [1, 2, 4]
    assert names("not like", "a%") == [2] and names("like", "a\\b") == [1] and names("like", "%\\") == []
    with pytest.raises(ValueError):
        list_query(df.select("v"), length=2)
