"""Registered digest queries (O-50..O-53): the scalar part, and the alert and product arrays flattened."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerflow.operators import digests as dg
from ledgerflow.plans.metrics_queries import _change, overdue_rows_sql
from ledgerflow.plans.registry import AS_OF, register

_SALES_VIEWS = ["sale_order", "sale_order_line", "product_product", "product_template", "companies"]

_SALES_BASE = f"""
, t AS (SELECT db, count(*) AS n, sum(amount_total) AS s FROM sale_order
        WHERE CAST(date_order AS DATE) = DATE '2001-07-31' AND state IN ('sale', 'done') GROUP BY db),
  y AS (SELECT db, sum(amount_total) AS s FROM sale_order
        WHERE CAST(date_order AS DATE) = DATE '2001-07-30' AND state IN ('sale', 'done') GROUP BY db),
  d AS (SELECT db, count(*) AS n FROM sale_order WHERE state = 'draft' GROUP BY db),
  tp AS (SELECT l.db, l.product_id, sum(l.product_uom_qty) AS q, sum(l.price_subtotal) AS rev
         FROM sale_order_line l JOIN sale_order o ON l.order_id = o.id AND l.db = o.db
         WHERE CAST(o.date_order AS DATE) = DATE '2001-07-31' AND o.state IN ('sale', 'done')
         GROUP BY l.db, l.product_id),
  tpr AS (SELECT *, row_number() OVER (PARTITION BY db ORDER BY rev DESC, product_id) AS rn FROM tp),
  base AS (SELECT c.db, coalesce(t.n, 0) AS n, coalesce(t.s, 0) AS s,
                  {_change('coalesce(t.s, 0)', 'coalesce(y.s, 0)')} AS cmp,
                  coalesce(d.n, 0) AS pend,
                  (SELECT count(*) FROM tpr WHERE tpr.db = c.db AND tpr.rn <= 5) AS n_products
           FROM companies c LEFT JOIN t ON c.db = t.db LEFT JOIN y ON c.db = y.db LEFT JOIN d ON c.db = d.db),
  alerts AS (SELECT db, 1 AS k, 'warning' AS type, 'No orders today' AS message FROM base WHERE n = 0
             UNION ALL
             SELECT db, 2, 'warning', 'Sales down ' || cmp || ' vs yesterday' FROM base
             WHERE n <> 0 AND cmp LIKE '-%' AND length(cmp) > 3
             UNION ALL
             SELECT db, 3, 'info', CAST(pend AS VARCHAR) || ' orders pending confirmation' FROM base WHERE pend > 0)"""


def _flat_digest(df: DataFrame) -> DataFrame:
    arrays = [c for c in ("alerts", "top_products") if c in df.columns]
    return df.select(*[c for c in df.columns if c not in arrays],
                     *[F.size(c).cast("bigint").alias(f"{c}_count") for c in arrays])


def _sales(fx) -> DataFrame:
    return dg.sales_digest(fx["sale_order"], fx["sale_order_line"], fx["product_product"], fx["product_template"],
                           AS_OF)


@register("sales_digest", _SALES_VIEWS, _SALES_BASE + """
SELECT b.db, 'sales_daily' AS digest_type, '2001-07-31' AS period,
       CAST(b.s AS DOUBLE) AS total_revenue, b.n AS order_count,
       CASE WHEN b.n > 0 THEN CAST(b.s AS DOUBLE) / b.n ELSE 0.0 END AS avg_order_value,
       b.cmp AS comparison_yesterday, b.pend AS pending_orders,
       (SELECT count(*) FROM alerts a WHERE a.db = b.db) AS alerts_count,
       b.n_products AS top_products_count
FROM base b
""")
def sales_digest(fx):
    """O-50: sales digest per company (scalar metrics plus alert and product counts)."""
    return _flat_digest(_sales(fx))


@register("sales_digest_alerts", _SALES_VIEWS, _SALES_BASE + """
SELECT db, 'sales_daily' AS digest_type, CAST(row_number() OVER (PARTITION BY db ORDER BY k) AS INTEGER) AS alert_no,
       type, message
FROM alerts
""")
def sales_digest_alerts(fx):
    """O-50 + O-53: the sales digest's alerts, one row each, in order."""
    return dg.explode_alerts(_sales(fx))


@register("sales_digest_products", _SALES_VIEWS, _SALES_BASE + """
SELECT r.db, CAST(r.rn AS INTEGER) AS rank, coalesce(pp.default_code, '') AS product_code,
       coalesce(pt.name, '') AS product_name, CAST(r.q AS DOUBLE) AS quantity, CAST(r.rev AS DOUBLE) AS revenue
FROM tpr r LEFT JOIN product_product pp ON r.product_id = pp.id
     LEFT JOIN product_template pt ON pp.product_tmpl_id = pt.id
WHERE r.rn <= 5
""")
def sales_digest_products(fx):
    """O-50: the sales digest's top products, one row each, in rank order."""
    return dg.explode_products(_sales(fx))


def _fin_base(limit: int | None) -> str:
    return overdue_rows_sql(0, limit) + """
, agg AS (SELECT db, count(*) AS n, sum(amount_residual) AS tot,
                 count(CASE WHEN days_overdue > 30 THEN 1 END) AS ns,
                 sum(CASE WHEN days_overdue > 30 THEN amount_residual END) AS sa FROM od GROUP BY db),
  base AS (SELECT c.db, coalesce(agg.n, 0) AS n, coalesce(agg.tot, 0) AS tot, coalesce(agg.ns, 0) AS ns,
                  coalesce(agg.sa, 0) AS sa FROM companies c LEFT JOIN agg ON c.db = agg.db),
  alerts AS (SELECT db, 1 AS k, 'warning' AS type,
                    CAST(n AS VARCHAR) || ' invoices overdue (Rp ' || format('{:,.0f}', CAST(tot AS DOUBLE)) || ')'
                    AS message FROM base WHERE n > 0
             UNION ALL
             SELECT db, 2, 'critical',
                    CAST(ns AS VARCHAR) || ' invoices >30 days overdue (Rp ' || format('{:,.0f}', CAST(sa AS DOUBLE))
                    || ')' FROM base WHERE ns > 0)"""


_FIN_ROWS = """
SELECT b.db, 'finance_daily' AS digest_type, '2001-07-31' AS period, CAST(0.0 AS DOUBLE) AS total_receivable,
       CAST(0.0 AS DOUBLE) AS total_payable,
       CAST(b.tot AS DOUBLE) AS overdue_receivable, b.n AS overdue_count, b.ns AS severe_overdue_count,
       (SELECT count(*) FROM alerts a WHERE a.db = b.db) AS alerts_count
FROM base b
"""
_FIN_ALERTS = """
SELECT db, 'finance_daily' AS digest_type,
       CAST(row_number() OVER (PARTITION BY db ORDER BY k) AS INTEGER) AS alert_no, type, message
FROM alerts
"""


def _finance(fx, limit: int | None = None) -> DataFrame:
    return dg.finance_digest(fx["account_move"], AS_OF, limit)


@register("finance_digest", ["account_move", "companies"], _fin_base(None) + _FIN_ROWS)
def finance_digest(fx):
    """O-51: finance digest per company, with true totals."""
    return _flat_digest(_finance(fx))


@register("finance_digest_alerts", ["account_move", "companies"], _fin_base(None) + _FIN_ALERTS)
def finance_digest_alerts(fx):
    """O-51 + O-53: the finance digest's alerts."""
    return dg.explode_alerts(_finance(fx))


@register("finance_digest_capped", ["account_move", "companies"], _fin_base(100) + _FIN_ROWS)
def finance_digest_capped(fx):
    """O-51 with totals over the 100 rows per company that the overdue list shows."""
    return _flat_digest(_finance(fx, 100))


@register("finance_digest_alerts_capped", ["account_move", "companies"], _fin_base(100) + _FIN_ALERTS)
def finance_digest_alerts_capped(fx):
    """O-51 + O-53 over the 100 rows per company that the overdue list shows."""
    return dg.explode_alerts(_finance(fx, 100))


_OPS_BASE = """
, po AS (SELECT db, count(*) AS n FROM sale_order WHERE state = 'draft' GROUP BY db),
  pd AS (SELECT db, count(*) AS n FROM stock_picking WHERE state IN ('confirmed', 'assigned') GROUP BY db),
  base AS (SELECT c.db, coalesce(po.n, 0) AS po, coalesce(pd.n, 0) AS pd
           FROM companies c LEFT JOIN po ON c.db = po.db LEFT JOIN pd ON c.db = pd.db),
  alerts AS (SELECT db, 1 AS k, 'warning' AS type, CAST(po AS VARCHAR) || ' orders awaiting confirmation' AS message
             FROM base WHERE po > 10
             UNION ALL
             SELECT db, 2, 'warning', CAST(pd AS VARCHAR) || ' deliveries pending' FROM base WHERE pd > 10)"""


def _ops(fx) -> DataFrame:
    return dg.ops_digest(fx["sale_order"], fx["stock_picking"], AS_OF)


@register("ops_digest", ["sale_order", "stock_picking", "companies"], _OPS_BASE + """
SELECT b.db, 'ops_daily' AS digest_type, '2001-07-31' AS period, b.po AS pending_orders,
       b.pd AS pending_deliveries, CAST(0 AS BIGINT) AS low_stock_items,
       (SELECT count(*) FROM alerts a WHERE a.db = b.db) AS alerts_count
FROM base b
""")
def ops_digest(fx):
    """O-52: operations digest per company."""
    return _flat_digest(_ops(fx))


@register("ops_digest_alerts", ["sale_order", "stock_picking", "companies"], _OPS_BASE + """
SELECT db, 'ops_daily' AS digest_type, CAST(row_number() OVER (PARTITION BY db ORDER BY k) AS INTEGER) AS alert_no,
       type, message
FROM alerts
""")
def ops_digest_alerts(fx):
    """O-52 + O-53: the operations digest's alerts."""
    return dg.explode_alerts(_ops(fx))
