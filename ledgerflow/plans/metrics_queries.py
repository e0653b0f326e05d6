"""Registered metric queries (O-40..O-49, O-54) with their DuckDB oracles."""

from __future__ import annotations

import uuid

from ledgerflow.operators import metrics as m
from ledgerflow.plans.registry import AS_OF, register
from ledgerflow.session import work_dir
from ledgerflow.sources.tables import write_bucketed

_PCT = ("(CASE WHEN {x} >= 0 THEN '+' ELSE '' END) || printf('%.0f', {x}) || '%'")


def _change(cur: str, prev: str) -> str:
    x = f"((CAST({cur} AS DOUBLE) - CAST({prev} AS DOUBLE)) / CAST({prev} AS DOUBLE) * 100.0)"
    return (f"CASE WHEN {prev} = 0 THEN (CASE WHEN {cur} = 0 THEN 'N/A' ELSE '+∞' END) "
            f"ELSE {_PCT.format(x=x)} END")


@register("sales_today", ["sale_order", "companies"], f"""
, t AS (SELECT db, count(*) AS n, sum(amount_total) AS s FROM sale_order
        WHERE CAST(date_order AS DATE) = DATE '2001-07-31' AND state IN ('sale', 'done') GROUP BY db),
  y AS (SELECT db, sum(amount_total) AS s FROM sale_order
        WHERE CAST(date_order AS DATE) = DATE '2001-07-30' AND state IN ('sale', 'done') GROUP BY db)
SELECT c.db, 'today' AS period,
       CAST(coalesce(t.s, 0) AS DOUBLE) AS total_revenue,
       coalesce(t.n, 0) AS order_count,
       CASE WHEN coalesce(t.n, 0) > 0 THEN CAST(t.s AS DOUBLE) / t.n ELSE 0.0 END AS avg_order_value,
       'IDR' AS currency,
       {_change('coalesce(t.s, 0)', 'coalesce(y.s, 0)')} AS comparison_previous
FROM companies c LEFT JOIN t ON c.db = t.db LEFT JOIN y ON c.db = y.db
""")
def sales_today(fx):
    """O-40 + O-42: completed orders on the reporting day per company, against the previous day."""
    return m.sales_summary(fx["sale_order"], AS_OF, "today")


@register("sales_mtd", ["sale_order", "companies"], """
, t AS (SELECT db, count(*) AS n, sum(amount_total) AS s FROM sale_order
        WHERE date_trunc('month', date_order) = TIMESTAMP '2001-07-01 00:00:00' AND state IN ('sale', 'done')
        GROUP BY db)
SELECT c.db, 'mtd' AS period,
       CAST(coalesce(t.s, 0) AS DOUBLE) AS total_revenue,
       coalesce(t.n, 0) AS order_count,
       CASE WHEN coalesce(t.n, 0) > 0 THEN CAST(t.s AS DOUBLE) / t.n ELSE 0.0 END AS avg_order_value,
       'IDR' AS currency,
       CAST(NULL AS VARCHAR) AS comparison_previous
FROM companies c LEFT JOIN t ON c.db = t.db
""")
def sales_mtd(fx):
    """O-41: completed orders in the calendar month of the reporting day, per company."""
    return m.sales_summary(fx["sale_order"], AS_OF, "mtd")


@register("sales_comparison", ["sale_order", "companies"], f"""
, t AS (SELECT db, sum(amount_total) AS s FROM sale_order
        WHERE CAST(date_order AS DATE) = DATE '2001-07-31' AND state IN ('sale', 'done') GROUP BY db),
  y AS (SELECT db, sum(amount_total) AS s FROM sale_order
        WHERE CAST(date_order AS DATE) = DATE '2001-07-30' AND state IN ('sale', 'done') GROUP BY db)
SELECT c.db, CAST(coalesce(t.s, 0) AS DOUBLE) AS current_revenue,
       CAST(coalesce(y.s, 0) AS DOUBLE) AS previous_revenue,
       {_change('coalesce(t.s, 0)', 'coalesce(y.s, 0)')} AS comparison
FROM companies c LEFT JOIN t ON c.db = t.db LEFT JOIN y ON c.db = y.db
""")
def sales_comparison(fx):
    """O-42: revenue of the reporting day against the previous day, as a signed whole percent."""
    return m.sales_comparison(fx["sale_order"], AS_OF, "yesterday")


def _top_products_sql(period_pred: str) -> str:
    return f"""
, agg AS (SELECT l.db, l.product_id, sum(l.product_uom_qty) AS q, sum(l.price_subtotal) AS rev
          FROM sale_order_line l JOIN sale_order o ON l.order_id = o.id AND l.db = o.db
          WHERE {period_pred} AND o.state IN ('sale', 'done')
          GROUP BY l.db, l.product_id),
  ranked AS (SELECT *, row_number() OVER (PARTITION BY db ORDER BY rev DESC, product_id) AS rn FROM agg)
SELECT r.db, CAST(r.rn AS INTEGER) AS rank, r.product_id, pp.default_code AS product_code, pt.name AS product_name,
       CAST(r.q AS DOUBLE) AS quantity, CAST(r.rev AS DOUBLE) AS revenue
FROM ranked r LEFT JOIN product_product pp ON r.product_id = pp.id
     LEFT JOIN product_template pt ON pp.product_tmpl_id = pt.id
WHERE r.rn <= 5
"""


_TP_VIEWS = ["sale_order", "sale_order_line", "product_product", "product_template"]


@register("top_products_today", _TP_VIEWS, _top_products_sql("CAST(o.date_order AS DATE) = DATE '2001-07-31'"))
def top_products_today(fx):
    """O-43: top 5 products by revenue per company on the reporting day."""
    return m.top_products(fx["sale_order_line"], fx["sale_order"], fx["product_product"], fx["product_template"],
                          AS_OF, "today")


@register("top_products_mtd", _TP_VIEWS,
          _top_products_sql("date_trunc('month', o.date_order) = TIMESTAMP '2001-07-01 00:00:00'"))
def top_products_mtd(fx):
    """O-43: top 5 products by revenue per company over the month of the reporting day."""
    return m.top_products(fx["sale_order_line"], fx["sale_order"], fx["product_product"], fx["product_template"],
                          AS_OF, "mtd")


def bucketed_lines_and_orders(fx, buckets: int = 8):
    """Order lines and orders stored in buckets of company and order."""
    tag = uuid.uuid4().hex
    root = work_dir(fx.spark, "tables", tag)
    lines = write_bucketed(fx["sale_order_line"], f"lines_{tag}", f"{root}/lines", ["db", "order_id"], buckets)
    orders = write_bucketed(fx["sale_order"], f"orders_{tag}", f"{root}/orders", ["db", "id"], buckets)
    return lines, orders


@register("top_products_mtd_bucketed", _TP_VIEWS,
          _top_products_sql("date_trunc('month', o.date_order) = TIMESTAMP '2001-07-01 00:00:00'"))
def top_products_mtd_bucketed(fx):
    """O-30 + O-43: the month's top products from bucketed tables: lines meet their orders without a shuffle."""
    lines, orders = bucketed_lines_and_orders(fx)
    return m.top_products(lines, orders, fx["product_product"], fx["product_template"], AS_OF, "mtd")


@register("customer_risk", ["account_move", "res_partner", "companies"], """
, mv AS (SELECT db, partner_id,
                sum(CASE WHEN amount_residual > 0 THEN amount_residual ELSE 0 END) AS recv,
                sum(CASE WHEN amount_residual > 0 AND invoice_date_due < DATE '2001-07-31'
                         THEN amount_residual ELSE 0 END) AS ovd,
                count(CASE WHEN amount_residual > 0 AND invoice_date_due < DATE '2001-07-31' THEN 1 END) AS n_ovd
         FROM account_move WHERE state = 'posted' AND move_type IN ('out_invoice', 'out_refund')
         GROUP BY db, partner_id)
SELECT c.db, p.id AS customer_id, p.name AS customer_name,
       CAST(coalesce(mv.recv, 0) AS DOUBLE) AS total_receivable,
       CAST(coalesce(mv.ovd, 0) AS DOUBLE) AS total_overdue,
       coalesce(mv.n_ovd, 0) AS overdue_count,
       CAST(0.0 AS DOUBLE) AS avg_days_to_pay,
       CAST(NULL AS DATE) AS last_payment_date,
       CASE WHEN coalesce(mv.ovd, 0) > 100000000 OR coalesce(mv.n_ovd, 0) > 5 THEN 'high'
            WHEN coalesce(mv.ovd, 0) > 50000000 OR coalesce(mv.n_ovd, 0) > 2 THEN 'medium'
            ELSE 'low' END AS risk_score
FROM companies c CROSS JOIN res_partner p
LEFT JOIN mv ON mv.db = c.db AND mv.partner_id = p.id
""")
def customer_risk(fx):
    """O-44 + O-54: receivable, overdue and risk score for every partner of every company."""
    return m.customer_risk(fx["account_move"], fx["res_partner"], AS_OF)


@register("pending_orders", ["sale_order", "companies"], """
SELECT c.db, coalesce(x.n, 0) AS pending_orders
FROM companies c LEFT JOIN (SELECT db, count(*) AS n FROM sale_order WHERE state = 'draft' GROUP BY db) x
ON c.db = x.db
""")
def pending_orders(fx):
    """O-45: draft sales orders per company."""
    return m.pending_orders(fx["sale_order"])


@register("pending_deliveries", ["stock_picking", "companies"], """
SELECT c.db, coalesce(x.n, 0) AS pending_deliveries
FROM companies c LEFT JOIN (SELECT db, count(*) AS n FROM stock_picking
                            WHERE state IN ('confirmed', 'assigned') GROUP BY db) x
ON c.db = x.db
""")
def pending_deliveries(fx):
    """O-46: confirmed or assigned deliveries per company."""
    return m.pending_deliveries(fx["stock_picking"])


def overdue_rows_sql(threshold: int, limit: int | None) -> str:
    """Oracle CTE ``od``: overdue customer invoices with rank per company."""
    cut = "DATE '2001-07-31'" if threshold == 0 else f"(DATE '2001-07-31' - {threshold})"
    keep = f"WHERE rn <= {limit}" if limit is not None else ""
    return f"""
, od0 AS (SELECT *, CAST(DATE '2001-07-31' - invoice_date_due AS INTEGER) AS days_overdue
          FROM account_move WHERE state = 'posted' AND move_type IN ('out_invoice', 'out_refund')
          AND amount_residual > 0 AND invoice_date_due < {cut}),
  od1 AS (SELECT *, row_number() OVER (PARTITION BY db ORDER BY days_overdue DESC, id) AS rn FROM od0),
  od AS (SELECT * FROM od1 {keep})"""


def _overdue_summary_sql(limit: int | None) -> str:
    return overdue_rows_sql(0, limit) + """
, agg AS (SELECT db, count(*) AS n, sum(amount_residual) AS tot,
                 count(CASE WHEN days_overdue > 30 THEN 1 END) AS ns,
                 sum(CASE WHEN days_overdue > 30 THEN amount_residual END) AS sa
          FROM od GROUP BY db)
SELECT c.db, coalesce(agg.n, 0) AS overdue_count, CAST(coalesce(agg.tot, 0) AS DOUBLE) AS total_overdue_amount,
       coalesce(agg.ns, 0) AS severe_overdue_count, CAST(coalesce(agg.sa, 0) AS DOUBLE) AS severe_overdue_amount
FROM companies c LEFT JOIN agg ON c.db = agg.db
"""


@register("overdue_summary", ["account_move", "companies"], _overdue_summary_sql(None))
def overdue_summary(fx):
    """O-47 + O-48: true overdue totals per company, and the >30-day part."""
    return m.overdue_summary(fx["account_move"], AS_OF)


@register("overdue_summary_capped", ["account_move", "companies"], _overdue_summary_sql(100))
def overdue_summary_capped(fx):
    """O-47 + O-48 over the 100 rows per company that the overdue list shows."""
    return m.overdue_summary(fx["account_move"], AS_OF, limit=100)
