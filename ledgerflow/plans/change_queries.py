"""Registered source, sink and change queries (O-01, O-02, O-04, O-77) with their DuckDB oracles."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ledgerflow.operators import approvals as ap
from ledgerflow.operators import changes as chg
from ledgerflow.plans.approval_queries import _AUDIT_SELECT, _INVOICE_BASE, _INVOICE_VIEWS
from ledgerflow.plans.registry import register
from ledgerflow.session import materialize, work_dir
from ledgerflow.sources.audit import AUDIT_COLUMNS, append_audit, read_audit
from ledgerflow.constants import COMPANIES
from ledgerflow.sources.tables import load_tables


@register("company_scan", ["sale_order"], """
SELECT * FROM sale_order WHERE db IN ('tln_db', 'ieg_db', 'tmi_db')
""")
def company_scan(fx):
    """O-01 + O-02: sales orders stored partitioned by company, read back through ``load_tables``
    (allowed companies only: a partition filter)."""
    path = work_dir(fx.spark, "tables", uuid.uuid4().hex, "sale_order")
    fx["sale_order"].write.partitionBy("db").parquet(path)
    return load_tables(fx.spark, {"sale_order": path})["sale_order"]


@register("company_scan_union", ["sale_order"], """
SELECT * FROM sale_order WHERE db IN ('tln_db', 'ieg_db', 'tmi_db')
""")
def company_scan_union(fx):
    """O-01: one folder per company (no ``db`` column, as with a schema per company), read through
    ``load_tables``, tagged with the company and unioned by name."""
    root = work_dir(fx.spark, "tables", uuid.uuid4().hex, "sale_order")
    # One write makes the per-company folders; read one by one they carry no db column.
    fx["sale_order"].write.partitionBy("db").parquet(root)
    paths = [f"{root}/db={db}" for db in COMPANIES]
    return load_tables(fx.spark, {"sale_order": paths})["sale_order"]


def _changes_sql(named: dict[str, str]) -> str:
    """Oracle of the change fold; ``named``: per column, when an update sets it."""
    types = {"grand_total": "DECIMAL(18,2)", "status": "VARCHAR", "delivery_status": "VARCHAR"}
    last = ",\n  ".join(f"""u_{c} AS (SELECT name, v FROM (
      SELECT h.name, h.{c} AS v, row_number() OVER (PARTITION BY h.name ORDER BY h.seq DESC) AS rn
      FROM sales_order_change h JOIN life USING (name)
      WHERE (h.op IN ('update', 'write') AND ({cond}) AND (born IS NULL OR h.seq > born))
            OR (h.op = 'create' AND h.seq = born)) x WHERE rn = 1)""" for c, cond in named.items())
    value = {c: f"CAST(CASE WHEN u_{c}.name IS NOT NULL THEN u_{c}.v WHEN l.born IS NULL THEN b.{c} END AS {t}) AS {c}"
             for c, t in types.items()}
    joins = " ".join(f"LEFT JOIN u_{c} ON u_{c}.name = k.name" for c in named)
    return f"""
, del AS (SELECT name, max(CASE WHEN op = 'delete' THEN seq END) AS d FROM sales_order_change GROUP BY name),
  born AS (SELECT h.name, min(h.seq) AS c FROM sales_order_change h JOIN del USING (name)
           WHERE h.op = 'create' AND (d IS NULL OR h.seq > d) GROUP BY h.name),
  life AS (SELECT del.name, CASE WHEN b.name IS NOT NULL AND d IS NULL THEN NULL ELSE c END AS born,
                  (b.name IS NOT NULL AND d IS NULL) OR c IS NOT NULL AS alive
           FROM del LEFT JOIN born USING (name) LEFT JOIN frappe_sales_order b ON b.name = del.name),
  {last},
  k AS (SELECT name FROM frappe_sales_order UNION SELECT name FROM sales_order_change)
SELECT k.name, CASE WHEN l.born IS NULL THEN b.customer END AS customer,
       CASE WHEN l.born IS NULL THEN b.transaction_date END AS transaction_date,
       {value['grand_total']}, {value['status']}, {value['delivery_status']},
       CASE WHEN l.born IS NULL THEN b.docstatus END AS docstatus
FROM k LEFT JOIN frappe_sales_order b ON b.name = k.name LEFT JOIN life l ON l.name = k.name {joins}
WHERE coalesce(l.alive, true)
"""


@register("apply_sales_order_changes", ["frappe_sales_order", "sales_order_change"], _changes_sql(
    {c: f"h.{c} IS NOT NULL" for c in ("status", "delivery_status", "grand_total")}))
def apply_sales_order_changes(fx):
    """O-77: the sales-order table after a log of create / update / write / delete changes, stored as a new
    snapshot and read back."""
    root = work_dir(fx.spark, "snapshots", uuid.uuid4().hex)
    chg.write_snapshot(chg.apply_changes(fx["frappe_sales_order"], fx["sales_order_change"], "name"), root, 1)
    return chg.latest_snapshot(fx.spark, root)


@register("apply_changes_by_range", ["frappe_sales_order", "sales_order_change"], _changes_sql(
    {c: f"h.{c} IS NOT NULL" for c in ("status", "delivery_status", "grand_total")}))
def apply_changes_by_range(fx):
    """O-77 on a table kept by ranges of its key: two batches, each rewriting only the ranges it names."""
    table, changes = fx["frappe_sales_order"], fx["sales_order_change"]
    path = work_dir(fx.spark, "ranged", uuid.uuid4().hex)
    chg.create_ranged(table, path, "name", range_rows=2_000)
    half = changes.agg(F.percentile_approx("seq", 0.5)).first()[0]
    for batch in (changes.where(F.col("seq") <= F.lit(half)), changes.where(F.col("seq") > F.lit(half))):
        chg.apply_to_ranged(fx.spark, path, table.schema, batch, "name")
    return chg.read_ranged(fx.spark, path, table.schema)


@register("apply_masked_changes", ["frappe_sales_order", "sales_order_change"], _changes_sql(
    {"status": "true", "delivery_status": "false", "grand_total": "h.seq % 3 <> 0"}))
def apply_masked_changes(fx):
    """O-77 with a field mask: an update sets the columns it names, to NULL too."""
    mask = F.when(F.col("seq") % 3 != 0, F.array(F.lit("status"), F.lit("grand_total"))).otherwise(F.array(F.lit("status")))
    changes = fx["sales_order_change"].withColumn("fields", mask)
    return chg.apply_changes(fx["frappe_sales_order"], changes, "name", mask_col="fields")


@register("refused_creates", ["frappe_sales_order", "sales_order_change"], """
, r AS (SELECT h.*, b.name IS NOT NULL AS here,
               max(CASE WHEN op = 'delete' THEN seq END) OVER (PARTITION BY h.name ORDER BY seq
                   ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS life
        FROM sales_order_change h LEFT JOIN frappe_sales_order b ON b.name = h.name WHERE op IN ('create', 'delete')),
  n AS (SELECT *, row_number() OVER (PARTITION BY name, life ORDER BY seq) AS nth FROM r WHERE op = 'create')
SELECT name, seq, op, status, delivery_status, grand_total FROM n WHERE nth > 1 OR (life IS NULL AND here)
""")
def refused_creates(fx):
    """O-77: creates that met a live key."""
    return chg.refused_creates(fx["frappe_sales_order"], fx["sales_order_change"], "name")


@register("audit_append", _INVOICE_VIEWS, _INVOICE_BASE + _AUDIT_SELECT.format(
    meta="CASE WHEN reason IS NOT NULL AND reason <> '' THEN CAST(to_json(struct_pack(reason := reason)) AS VARCHAR) END"))
def audit_append(fx):
    """O-03 + O-04: invoice audit rows appended twice (the replay is dropped) and read back from the table."""
    outcomes = ap.apply_approvals(fx["approval_request"], fx["account_move"], "invoice", fx["res_partner"])
    rows = materialize(ap.audit_rows(outcomes))  # the batch to append, computed once
    path = work_dir(fx.spark, "audit", uuid.uuid4().hex)
    append_audit(rows, path)
    append_audit(rows, path)
    return read_audit(fx.spark, path).select(*AUDIT_COLUMNS)
