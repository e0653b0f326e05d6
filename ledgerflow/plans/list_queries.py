"""Registered list and point-read queries (O-10..O-26) with their DuckDB oracles."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ledgerflow.operators import lists as ls
from ledgerflow.operators import trigrams as tg
from ledgerflow.plans.metrics_queries import overdue_rows_sql
from ledgerflow.plans.registry import AS_OF, register
from ledgerflow.session import work_dir
from ledgerflow.sources.tables import load_tables, write_company_table
from ledgerflow.sources.audit import AUDIT_COLUMNS, append_audit, audit_by, conform_audit, read_audit


@register("invoice_detail", ["account_move", "res_partner", "res_currency"], """
SELECT am.db, am.id, am.name, am.state, am.move_type,
       CAST(am.amount_total AS DOUBLE) AS amount_total, CAST(am.amount_residual AS DOUBLE) AS amount_residual,
       am.currency_id, am.date, am.invoice_date, am.invoice_date_due,
       rp.name AS partner_name, rp.id AS partner_id, rc.symbol AS currency_symbol
FROM account_move am LEFT JOIN res_partner rp ON am.partner_id = rp.id
     LEFT JOIN res_currency rc ON am.currency_id = rc.id
""")
def invoice_detail(fx):
    """O-10: every invoice with its partner and currency."""
    return ls.invoice_detail(fx["account_move"], fx["res_partner"], fx["res_currency"])


@register("invoice_detail_by_ids", ["account_move", "res_partner", "res_currency", "approval_request"], """
SELECT am.db, am.id, am.name, am.state, am.move_type,
       CAST(am.amount_total AS DOUBLE) AS amount_total, CAST(am.amount_residual AS DOUBLE) AS amount_residual,
       am.currency_id, am.date, am.invoice_date, am.invoice_date_due,
       rp.name AS partner_name, rp.id AS partner_id, rc.symbol AS currency_symbol
FROM account_move am LEFT JOIN res_partner rp ON am.partner_id = rp.id
     LEFT JOIN res_currency rc ON am.currency_id = rc.id
WHERE EXISTS (SELECT 1 FROM approval_request r WHERE r.db = am.db AND r.object_id = am.id)
""")
def invoice_detail_by_ids(fx):
    """O-10 by a table of ids, from invoices stored in the order of their ids: the ids' ranges are pushed down."""
    path = work_dir(fx.spark, "tables", uuid.uuid4().hex, "account_move")
    write_company_table(fx["account_move"], path, ["id"], files_per_company=8)
    ids = fx["approval_request"].select("db", F.col("object_id").alias("id"))
    return ls.invoice_detail(load_tables(fx.spark, {"account_move": path})["account_move"], fx["res_partner"], fx["res_currency"],
                             ids, clustered=True)


@register("read_expenses", ["hr_expense", "approval_request_expense"], """
SELECT e.db, e.id, e.name, e.state, e.total_amount, e.employee_id, e.employee_name, e.date, e.description
FROM hr_expense e
WHERE EXISTS (SELECT 1 FROM approval_request_expense r WHERE r.db = e.db AND r.object_id = e.id)
""")
def read_expenses(fx):
    """O-11 / O-26: expenses named by approval requests (a semi-join on company and id)."""
    ids = fx["approval_request_expense"].select("db", F.col("object_id").alias("id"))
    return ls.read_expenses(fx["hr_expense"], ids)


@register("read_leaves", ["hr_leave", "approval_request_leave"], """
SELECT v.db, v.id, v.display_name, v.state, v.employee_id, v.employee_name, v.date_from, v.date_to,
       v.number_of_days, v.holiday_status_name
FROM hr_leave v
WHERE EXISTS (SELECT 1 FROM approval_request_leave r WHERE r.db = v.db AND r.object_id = v.id)
""")
def read_leaves(fx):
    """O-11 / O-26: leave requests named by approval requests."""
    ids = fx["approval_request_leave"].select("db", F.col("object_id").alias("id"))
    return ls.read_leaves(fx["hr_leave"], ids)


@register("sales_orders_page", ["frappe_sales_order"], """
SELECT name, customer, transaction_date, grand_total, status, delivery_status FROM frappe_sales_order
WHERE status = 'To Deliver and Bill'
ORDER BY grand_total DESC, name LIMIT 20 OFFSET 20
""")
def sales_orders_page(fx):
    """O-12: generic list query, equality filter, custom order, second page of 20."""
    return ls.list_query(fx["frappe_sales_order"], {"status": "To Deliver and Bill"}, ls.SALES_ORDER_FIELDS,
                         "grand_total desc", start=20, length=20)


@register("search_sales_orders", ["frappe_sales_order"], """
SELECT name, customer, grand_total, status FROM frappe_sales_order
WHERE grand_total >= 400000000 AND (status <> 'Completed' OR status IS NULL)
  AND lower(customer) LIKE '%00001%' AND docstatus IN (0, 1)
""")
def search_sales_orders(fx):
    """O-13: search with operator triples (>=, !=, like, in) and no limit: every match."""
    return ls.search(fx["frappe_sales_order"],
                     [["grand_total", ">=", 400000000], ["status", "!=", "Completed"],
                      ["customer", "like", "%00001%"], ["docstatus", "in", [0, 1]]],
                     ["name", "customer", "grand_total", "status"], key=("name",))


@register("count_sales_orders", ["frappe_sales_order"], """
SELECT count(*) AS count FROM frappe_sales_order WHERE docstatus = 1 AND status <> 'Completed'
""")
def count_sales_orders(fx):
    """O-15: count with filters."""
    return ls.count_query(fx["frappe_sales_order"], {"docstatus": 1, "status": ["!=", "Completed"]})


@register("crm_leads", ["lead"], """
SELECT name, lead_name, company_name, status, source, creation FROM lead
ORDER BY creation DESC, name LIMIT 20
""")
def crm_leads(fx):
    """O-16: newest 20 leads."""
    return ls.crm_leads(fx["lead"])


@register("crm_leads_open", ["lead"], """
SELECT name, lead_name, company_name, status, source, creation FROM lead WHERE status = 'Open'
ORDER BY creation DESC, name LIMIT 20
""")
def crm_leads_open(fx):
    """O-16 with a status filter."""
    return ls.crm_leads(fx["lead"], status="Open")


@register("customer_detail", ["frappe_customer", "frappe_sales_order"], """
SELECT name, customer_name, customer_group, territory, customer_type, default_currency FROM frappe_customer
WHERE name IN (SELECT customer FROM frappe_sales_order)
""")
def customer_detail(fx):
    """O-14 / O-17: the customer documents of every sales order's customer."""
    return ls.customer_detail(fx["frappe_customer"], fx["frappe_sales_order"].select(F.col("customer").alias("name")))


@register("search_customers", ["frappe_customer"], """
SELECT name, customer_name, customer_group, territory FROM frappe_customer
WHERE lower(customer_name) LIKE '%customer#0000001%'
ORDER BY name LIMIT 10
""")
def search_customers(fx):
    """O-18: customer-name search, case-insensitive, first 10 by name."""
    return ls.search_customers(fx["frappe_customer"], "customer#0000001")


@register("search_customers_indexed", ["frappe_customer"], """
SELECT name, customer_name, customer_group, territory FROM frappe_customer
WHERE lower(customer_name) LIKE '%mer#00000_1%'
ORDER BY name LIMIT 10
""")
def search_customers_indexed(fx):
    """O-18: a customer-name search with a wildcard, by the trigrams of the names."""
    path = work_dir(fx.spark, "grams", uuid.uuid4().hex)
    tg.write_grams(fx["frappe_customer"], path, "name", "customer_name")
    return tg.search_customers_indexed(fx["frappe_customer"], path, "mer#00000_1")


@register("order_with_lines", ["frappe_sales_order", "frappe_sales_order_item"], """
SELECT o.name, o.customer, o.transaction_date, o.grand_total, o.status, o.delivery_status, o.docstatus,
       i.idx, i.item_code, i.qty, i.amount
FROM frappe_sales_order o LEFT JOIN frappe_sales_order_item i ON i.parent = o.name
""")
def order_with_lines(fx):
    """O-19: every sales order with its item rows (flat)."""
    return ls.order_with_lines(fx["frappe_sales_order"], fx["frappe_sales_order_item"])


@register("sales_orders", ["frappe_sales_order"], """
SELECT name, customer, transaction_date, grand_total, status, delivery_status FROM frappe_sales_order
WHERE docstatus <> 2 ORDER BY transaction_date DESC, name LIMIT 20
""")
def sales_orders(fx):
    """O-20: newest 20 sales orders that are not cancelled."""
    return ls.sales_orders(fx["frappe_sales_order"])


@register("sales_orders_draft", ["frappe_sales_order"], """
SELECT name, customer, transaction_date, grand_total, status, delivery_status FROM frappe_sales_order
WHERE docstatus <> 2 AND status = 'Draft' ORDER BY transaction_date DESC, name LIMIT 20
""")
def sales_orders_draft(fx):
    """O-20 with a status filter."""
    return ls.sales_orders(fx["frappe_sales_order"], status="Draft")


@register("sales_invoice_detail", ["frappe_sales_invoice", "frappe_sales_order"], """
SELECT * FROM frappe_sales_invoice
WHERE name IN (SELECT 'ACC-SINV-' || substr(name, 9) FROM frappe_sales_order WHERE status = 'To Deliver and Bill')
""")
def sales_invoice_detail(fx):
    """O-21: invoice documents of the orders still to deliver and bill."""
    names = (fx["frappe_sales_order"].filter(F.col("status") == "To Deliver and Bill")
             .select(F.concat(F.lit("ACC-SINV-"), F.substring("name", 9, 1 << 20)).alias("name")))
    return ls.sales_invoice(fx["frappe_sales_invoice"], names)


@register("sales_invoices", ["frappe_sales_invoice"], """
SELECT name, customer, posting_date, grand_total, outstanding_amount, status FROM frappe_sales_invoice
WHERE docstatus = 1 AND is_return = 0 ORDER BY posting_date DESC, name LIMIT 20
""")
def sales_invoices(fx):
    """O-22: newest 20 submitted invoices."""
    return ls.sales_invoices(fx["frappe_sales_invoice"])


@register("sales_returns", ["frappe_sales_invoice"], """
SELECT name, customer, posting_date, grand_total, outstanding_amount, status FROM frappe_sales_invoice
WHERE docstatus = 1 AND is_return = 1 AND status = 'Unpaid' ORDER BY posting_date DESC, name LIMIT 20
""")
def sales_returns(fx):
    """O-22 with ``is_return`` and a status filter."""
    return ls.sales_invoices(fx["frappe_sales_invoice"], status="Unpaid", is_return=True)


@register("pending_invoices", ["account_move", "res_partner"], """
, p AS (SELECT *, row_number() OVER (PARTITION BY db ORDER BY create_date DESC NULLS FIRST, id) AS rn
        FROM account_move WHERE state = 'draft' AND move_type IN ('out_invoice', 'out_refund'))
SELECT p.db, CAST(p.rn AS INTEGER) AS rank, p.id, p.name, p.state, CAST(p.amount_total AS DOUBLE) AS amount_total,
       p.create_date, rp.name AS partner_name
FROM p LEFT JOIN res_partner rp ON p.partner_id = rp.id
WHERE p.rn <= 100
""")
def pending_invoices(fx):
    """O-23: newest 100 draft customer invoices per company."""
    return ls.pending_invoices(fx["account_move"], fx["res_partner"])


@register("overdue_invoices", ["account_move", "res_partner", "res_currency"], overdue_rows_sql(0, 100) + """
SELECT od.db, CAST(od.rn AS INTEGER) AS rank, od.id, od.name, od.state, coalesce(rp.name, 'Unknown') AS partner_name,
       CAST(od.amount_total AS DOUBLE) AS amount_total, CAST(od.amount_residual AS DOUBLE) AS amount_residual,
       od.invoice_date_due AS date_due, od.days_overdue,
       coalesce(nullif(rc.symbol, ''), 'IDR') AS currency
FROM od LEFT JOIN res_partner rp ON od.partner_id = rp.id LEFT JOIN res_currency rc ON od.currency_id = rc.id
""")
def overdue_invoices(fx):
    """O-24: 100 most overdue customer invoices per company."""
    return ls.overdue_invoices(fx["account_move"], fx["res_partner"], fx["res_currency"], AS_OF)


@register("overdue_invoices_all", ["account_move", "res_partner", "res_currency"], overdue_rows_sql(30, None) + """
SELECT od.db, od.rn AS rank, od.id, od.name, od.state, coalesce(rp.name, 'Unknown') AS partner_name,
       CAST(od.amount_total AS DOUBLE) AS amount_total, CAST(od.amount_residual AS DOUBLE) AS amount_residual,
       od.invoice_date_due AS date_due, od.days_overdue,
       coalesce(nullif(rc.symbol, ''), 'IDR') AS currency
FROM od LEFT JOIN res_partner rp ON od.partner_id = rp.id LEFT JOIN res_currency rc ON od.currency_id = rc.id
""")
def overdue_invoices_all(fx):
    """O-24 uncapped with a 30-day threshold: every invoice more than 30 days overdue, ranked."""
    return ls.overdue_invoices(fx["account_move"], fx["res_partner"], fx["res_currency"], AS_OF,
                               threshold_days=30, limit=None)


_AUDIT_COLS = ("CAST(id AS VARCHAR) AS id, created_at, action_type, actor, actor_role, odoo_db, object_type, "
               "object_id, object_data, result, error_message, metadata, source, request_id")


@register("recent_audit", ["audit_log"], f"""
SELECT {_AUDIT_COLS} FROM audit_log ORDER BY created_at DESC, CAST(id AS VARCHAR) DESC LIMIT 100
""")
def recent_audit(fx):
    """O-25: newest 100 audit rows."""
    return ls.recent_audit(conform_audit(fx["audit_log"]))


@register("recent_audit_rejects", ["audit_log"], f"""
SELECT {_AUDIT_COLS} FROM audit_log WHERE action_type = 'invoice.reject' AND actor = 'user1@example.com'
ORDER BY created_at DESC, CAST(id AS VARCHAR) DESC LIMIT 100
""")
def recent_audit_rejects(fx):
    """O-25 filtered on action type and actor."""
    return ls.recent_audit(conform_audit(fx["audit_log"]), action_type="invoice.reject", actor="user1@example.com")


def _stored_audit(fx):
    """The audit log in the layout of the audit table (days, sorted files, Bloom filters)."""
    path = work_dir(fx.spark, "audit", uuid.uuid4().hex)
    append_audit(fx["audit_log"], path)
    return read_audit(fx.spark, path)


@register("recent_audit_partitioned", ["audit_log"], f"""
SELECT {_AUDIT_COLS} FROM audit_log ORDER BY created_at DESC, CAST(id AS VARCHAR) DESC LIMIT 100
""")
def recent_audit_partitioned(fx):
    """O-25 on the stored table: only the newest days that hold 100 rows are read whole."""
    return ls.recent_audit(_stored_audit(fx)).select(*AUDIT_COLUMNS)


@register("audit_by_actor", ["audit_log"], f"""
SELECT {_AUDIT_COLS} FROM audit_log WHERE actor = 'user1@example.com' ORDER BY created_at, CAST(id AS VARCHAR)
""")
def audit_by_actor(fx):
    """O-03: all audit rows of one actor, found by Bloom filters and statistics."""
    return audit_by(_stored_audit(fx), actor="user1@example.com").select(*AUDIT_COLUMNS)


@register("audit_by_object", ["audit_log"], f"""
SELECT {_AUDIT_COLS} FROM audit_log WHERE object_type = 'invoice' AND object_id = (SELECT min(object_id) FROM audit_log WHERE object_type = 'invoice')
""")
def audit_by_object(fx):
    """O-03: the history of one object."""
    table = _stored_audit(fx)
    first = table.where("object_type = 'invoice'").agg(F.min("object_id")).first()[0]
    return audit_by(table, object_type="invoice", object_id=first).select(*AUDIT_COLUMNS)


_ORDER_COLUMNS = "name, customer, transaction_date, grand_total, status, delivery_status"
#: A row number beyond the pages that one task gathers, in a table of 15,000 orders.
DEEP = 12_000


@register("sales_orders_deep_page", ["frappe_sales_order"], f"""
SELECT {_ORDER_COLUMNS} FROM frappe_sales_order ORDER BY transaction_date DESC, name LIMIT 20 OFFSET {DEEP}
""")
def sales_orders_deep_page(fx):
    """O-12 + O-39: page 601 of all orders, newest first: the dates at its ends are located by counting."""
    return ls.list_query(fx["frappe_sales_order"], None, ls.SALES_ORDER_FIELDS, "transaction_date desc", start=DEEP, length=20)


@register("sales_orders_keyset_page", ["frappe_sales_order"], f"""
SELECT {_ORDER_COLUMNS} FROM frappe_sales_order ORDER BY transaction_date DESC, name LIMIT 20 OFFSET {DEEP}
""")
def sales_orders_keyset_page(fx):
    """O-12 + O-39: the same page, as the one behind the last row of the page before."""
    table, order = fx["frappe_sales_order"], "transaction_date desc"
    page = ls.list_query(table, None, ls.SALES_ORDER_FIELDS, order, start=DEEP - 20, length=20)
    last = ls.next_page(page, order)
    return ls.list_query(table, None, ls.SALES_ORDER_FIELDS, order, length=20, after=last).where(
        F.lit(last is not None))


@register("sales_orders_top_large", ["frappe_sales_order"], f"""
SELECT {_ORDER_COLUMNS} FROM frappe_sales_order ORDER BY grand_total DESC NULLS LAST, name LIMIT {DEEP}
""")
def sales_orders_top_large(fx):
    """O-37 with a large k: the 12,000 largest orders, none of them gathered in one task."""
    return ls.list_query(fx["frappe_sales_order"], None, ls.SALES_ORDER_FIELDS, "grand_total desc", length=DEEP)


@register("pending_invoices_top_large", ["account_move", "res_partner"], """
, p AS (SELECT *, row_number() OVER (PARTITION BY db ORDER BY create_date DESC NULLS FIRST, id) AS rn
        FROM account_move WHERE state = 'posted' AND move_type IN ('out_invoice', 'out_refund'))
SELECT p.db, CAST(p.rn AS INTEGER) AS rank, p.id, p.name, p.state, CAST(p.amount_total AS DOUBLE) AS amount_total,
       p.create_date, rp.name AS partner_name
FROM p LEFT JOIN res_partner rp ON p.partner_id = rp.id
WHERE p.rn <= 1500
""")
def pending_invoices_top_large(fx):
    """O-36 with a k above the group limit: the newest 1,500 posted customer invoices per company."""
    return ls.pending_invoices(fx["account_move"], fx["res_partner"], state="posted", limit=1_500)
