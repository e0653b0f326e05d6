"""Registered work-list and context queries (O-49, O-55..O-57) with their DuckDB oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerflow.operators import worklists as wl
from ledgerflow.plans.metrics_queries import overdue_rows_sql
from ledgerflow.plans.registry import AS_OF, register

_PENDING_SQL = """
, p AS (SELECT *, row_number() OVER (PARTITION BY db ORDER BY create_date DESC NULLS FIRST, id) AS rn
        FROM account_move WHERE state = 'draft' AND move_type IN ('out_invoice', 'out_refund')),
  p20 AS (SELECT *, coalesce(create_date, TIMESTAMP '2001-07-31 00:00:00') AS since,
                 CAST(DATE '2001-07-31' - CAST(coalesce(create_date, TIMESTAMP '2001-07-31 00:00:00') AS DATE)
                      AS INTEGER) AS days
          FROM p WHERE rn <= 20)"""

_OVERDUE_ITEMS_SQL = overdue_rows_sql(14, 20)


@register("pending_approvals", ["account_move"], _PENDING_SQL + """
SELECT db, CAST(rn AS INTEGER) AS rank, 'invoice' AS object_type, CAST(id AS VARCHAR) AS object_id,
       coalesce(name, 'Invoice ' || CAST(id AS VARCHAR)) AS display_name,
       CAST(amount_total AS DOUBLE) AS amount, since AS waiting_since, days AS days_pending,
       CASE WHEN days > 7 OR amount_total > 100000000 THEN 'high'
            WHEN days > 3 OR amount_total > 50000000 THEN 'medium' ELSE 'low' END AS priority,
       CAST(NULL AS VARCHAR) AS assignee
FROM p20
""")
def pending_approvals(fx):
    """O-55: newest 20 draft customer invoices per company with days pending and priority."""
    return wl.pending_approvals(fx["account_move"], AS_OF)


@register("overdue_items", ["account_move"], _OVERDUE_ITEMS_SQL + """
SELECT db, CAST(rn AS INTEGER) AS rank, 'invoice' AS object_type, CAST(id AS VARCHAR) AS object_id,
       coalesce(name, 'Invoice ' || CAST(id AS VARCHAR)) AS display_name,
       CAST(amount_residual AS DOUBLE) AS amount,
       coalesce(CAST(invoice_date_due AS TIMESTAMP), TIMESTAMP '2001-07-31 00:00:00') AS waiting_since,
       days_overdue AS days_pending,
       CASE WHEN days_overdue > 30 OR amount_residual > 100000000 THEN 'critical'
            WHEN days_overdue > 14 OR amount_residual > 50000000 THEN 'high'
            WHEN days_overdue > 7 THEN 'medium' ELSE 'low' END AS priority,
       CAST(NULL AS VARCHAR) AS assignee
FROM od
""")
def overdue_items(fx):
    """O-56: 20 most overdue invoices per company past a 14-day threshold, with priority."""
    return wl.overdue_items(fx["account_move"], AS_OF)


@register("pending_item_counts", ["account_move", "companies"], _PENDING_SQL + overdue_rows_sql(14, None) + """
SELECT c.db, (SELECT count(*) FROM p WHERE p.db = c.db) AS pending_approvals_count,
       (SELECT count(*) FROM od WHERE od.db = c.db) AS overdue_items_count
FROM companies c
""")
def pending_item_counts(fx):
    """O-49: true item counts of both work lists per company."""
    return wl.pending_item_counts(fx["account_move"], AS_OF)


@register("pending_item_counts_capped", ["account_move", "companies"], _PENDING_SQL + _OVERDUE_ITEMS_SQL + """
SELECT c.db, (SELECT count(*) FROM p20 WHERE p20.db = c.db) AS pending_approvals_count,
       (SELECT count(*) FROM od WHERE od.db = c.db) AS overdue_items_count
FROM companies c
""")
def pending_item_counts_capped(fx):
    """O-49: item counts of the work lists cut at 20 items."""
    return wl.pending_item_counts(fx["account_move"], AS_OF, limit=20)


def _flat_context(df: DataFrame, info: list[str]) -> DataFrame:
    return df.select(
        *[c for c in df.columns if c not in ("available_actions", "additional_info")],
        F.array_join("available_actions", ",").alias("available_actions"),
        *[F.col(f"additional_info.{k}").alias(f"info_{k}") for k in info],
    )


@register("invoice_context", ["account_move", "res_partner"], """
SELECT am.db, 'invoice' AS object_type, CAST(am.id AS VARCHAR) AS object_id,
       coalesce(am.name, 'Invoice ' || CAST(am.id AS VARCHAR)) AS display_name, am.state,
       CAST(am.amount_total AS DOUBLE) AS amount, coalesce(rp.name, 'Unknown') AS partner,
       am.invoice_date_due AS due_date,
       CASE WHEN am.state = 'posted' AND am.invoice_date_due IS NOT NULL
            THEN CAST(greatest(0, DATE '2001-07-31' - am.invoice_date_due) AS INTEGER) ELSE 0 END AS days_overdue,
       CASE WHEN am.state = 'draft' THEN 'approve,reject,view'
            WHEN am.state IN ('posted', 'cancel') THEN 'view' ELSE '' END AS available_actions,
       CASE WHEN am.state = 'draft' THEN 'manager' END AS requires_role,
       CAST(am.amount_residual AS DOUBLE) AS info_amount_residual, coalesce(am.move_type, '') AS info_move_type
FROM account_move am LEFT JOIN res_partner rp ON am.partner_id = rp.id
""")
def invoice_context(fx):
    """O-57a: actions, role and days overdue for every invoice."""
    return _flat_context(wl.invoice_context(fx["account_move"], fx["res_partner"], AS_OF),
                         ["amount_residual", "move_type"])


@register("expense_context", ["hr_expense"], """
SELECT db, 'expense' AS object_type, CAST(id AS VARCHAR) AS object_id,
       coalesce(name, 'Expense ' || CAST(id AS VARCHAR)) AS display_name, state,
       CAST(total_amount AS DOUBLE) AS amount, coalesce(employee_name, 'Unknown') AS partner,
       CAST(NULL AS DATE) AS due_date, 0 AS days_overdue,
       CASE WHEN state IN ('draft', 'reported') THEN 'approve,reject,view' ELSE 'view' END AS available_actions,
       CASE WHEN state IN ('draft', 'reported') THEN 'manager' END AS requires_role,
       coalesce(description, '') AS info_description
FROM hr_expense
""")
def expense_context(fx):
    """O-57b: actions and role for every expense."""
    return _flat_context(wl.expense_context(fx["hr_expense"]), ["description"])


@register("leave_context", ["hr_leave"], """
SELECT db, 'leave' AS object_type, CAST(id AS VARCHAR) AS object_id,
       coalesce(display_name, 'Leave ' || CAST(id AS VARCHAR)) AS display_name, state,
       CAST(NULL AS DOUBLE) AS amount, coalesce(employee_name, 'Unknown') AS partner,
       CAST(NULL AS DATE) AS due_date, 0 AS days_overdue,
       CASE WHEN state = 'confirm' THEN 'approve,reject,view' ELSE 'view' END AS available_actions,
       CASE WHEN state = 'confirm' THEN 'manager' END AS requires_role,
       coalesce(holiday_status_name, 'Leave') AS info_leave_type,
       coalesce(number_of_days, 0.0) AS info_number_of_days,
       coalesce(CAST(date_from AS VARCHAR), '') AS info_date_from,
       coalesce(CAST(date_to AS VARCHAR), '') AS info_date_to
FROM hr_leave
""")
def leave_context(fx):
    """O-57c: actions, role and leave details for every leave request."""
    return _flat_context(wl.leave_context(fx["hr_leave"]), ["leave_type", "number_of_days", "date_from", "date_to"])
