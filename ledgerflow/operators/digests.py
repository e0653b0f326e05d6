"""Daily digests per company with their alert lists (O-50..O-53).

Each digest joins per-company results on ``db``; every part holds at most one
row per allowed company, so those joins broadcast a bounded side. Arrays are
bounded too: at most ``TOP_PRODUCTS_LIMIT`` products and three alerts.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerflow import functions as lf
from ledgerflow.constants import (
    ALERT_DELIVERIES_PENDING, ALERT_NO_ORDERS, ALERT_ORDERS_AWAITING, ALERT_OVERDUE, ALERT_PENDING_ORDERS,
    ALERT_SALES_DOWN, ALERT_SEVERE_OVERDUE, OPS_ALERT_MIN, TOP_PRODUCTS_LIMIT,
)
from ledgerflow.operators.metrics import overdue_summary, pending_deliveries, pending_orders, sales_summary, top_products

ALERT_TYPE = "struct<type:string,message:string>"


def _alert(cond: Column, kind: str, message: Column) -> Column:
    return F.when(cond, F.struct(F.lit(kind).alias("type"), message.alias("message")))


def alerts(*items: Column) -> Column:
    """O-53: the ordered list of alerts whose condition holds."""
    return F.array_compact(F.array(*items)).cast(f"array<{ALERT_TYPE}>")


# O-50
def sales_digest(orders: DataFrame, lines: DataFrame, products: DataFrame, templates: DataFrame,
                 as_of: dt.date | str, dbs: Iterable[str] | None = None,
                 top_limit: int = TOP_PRODUCTS_LIMIT) -> DataFrame:
    s = sales_summary(orders, as_of, "today", dbs)
    p = pending_orders(orders, dbs)
    tp = top_products(lines, orders, products, templates, as_of, "today", top_limit, dbs)
    prods = (tp.groupBy("db").agg(F.array_sort(F.collect_list(F.struct(
        F.col("rank"),
        F.coalesce("product_code", F.lit("")).alias("product_code"),
        F.coalesce("product_name", F.lit("")).alias("product_name"),
        F.col("quantity"), F.col("revenue"),
    ))).alias("_tp")))
    j = s.join(F.broadcast(p), "db").join(F.broadcast(prods), "db", "left")
    n, cmp_, pend = F.col("order_count"), F.col("comparison_previous"), F.col("pending_orders")
    top = F.transform(F.coalesce(F.col("_tp"), F.array().cast(prods.schema["_tp"].dataType)),
                      lambda x: x.dropFields("rank"))
    return j.select(
        "db", F.lit("sales_daily").alias("digest_type"), F.lit(lf.as_date(as_of).isoformat()).alias("period"),
        "total_revenue", "order_count", "avg_order_value",
        top.alias("top_products"),
        cmp_.alias("comparison_yesterday"),
        pend.alias("pending_orders"),
        alerts(
            _alert(n == 0, "warning", F.lit(ALERT_NO_ORDERS)),
            _alert((n != 0) & cmp_.startswith("-") & (F.length(cmp_) > 3), "warning",
                   lf.fill(ALERT_SALES_DOWN, comparison=cmp_)),
            _alert(pend > 0, "info", lf.fill(ALERT_PENDING_ORDERS, count=pend)),
        ).alias("alerts"),
    )


# O-51
def finance_digest(moves: DataFrame, as_of: dt.date | str, limit: int | None = None,
                   dbs: Iterable[str] | None = None) -> DataFrame:
    o = overdue_summary(moves, as_of, 0, limit, dbs)
    n, total = F.col("overdue_count"), F.col("total_overdue_amount")
    sn, samt = F.col("severe_overdue_count"), F.col("severe_overdue_amount")
    return o.select(
        "db", F.lit("finance_daily").alias("digest_type"), F.lit(lf.as_date(as_of).isoformat()).alias("period"),
        F.lit(0.0).alias("total_receivable"), F.lit(0.0).alias("total_payable"),
        total.alias("overdue_receivable"), n.alias("overdue_count"), sn.alias("severe_overdue_count"),
        alerts(
            _alert(n > 0, "warning", lf.fill(ALERT_OVERDUE, count=n, amount=lf.rupiah(total))),
            _alert(sn > 0, "critical", lf.fill(ALERT_SEVERE_OVERDUE, count=sn, amount=lf.rupiah(samt))),
        ).alias("alerts"),
    )


# O-52
def ops_digest(orders: DataFrame, pickings: DataFrame, as_of: dt.date | str,
               dbs: Iterable[str] | None = None) -> DataFrame:
    j = pending_orders(orders, dbs).join(F.broadcast(pending_deliveries(pickings, dbs)), "db")
    po, pd_ = F.col("pending_orders"), F.col("pending_deliveries")
    return j.select(
        "db", F.lit("ops_daily").alias("digest_type"), F.lit(lf.as_date(as_of).isoformat()).alias("period"),
        po, pd_, F.lit(0).cast("bigint").alias("low_stock_items"),
        alerts(
            _alert(po > OPS_ALERT_MIN, "warning", lf.fill(ALERT_ORDERS_AWAITING, count=po)),
            _alert(pd_ > OPS_ALERT_MIN, "warning", lf.fill(ALERT_DELIVERIES_PENDING, count=pd_)),
        ).alias("alerts"),
    )


def explode_alerts(digest: DataFrame) -> DataFrame:
    """One row per alert: ``db, digest_type, alert_no (1-based), type, message``."""
    return digest.select("db", "digest_type", F.posexplode("alerts").alias("_pos", "_a")).select(
        "db", "digest_type", (F.col("_pos") + 1).alias("alert_no"),
        F.col("_a.type").alias("type"), F.col("_a.message").alias("message"))


def explode_products(digest: DataFrame) -> DataFrame:
    return digest.select("db", F.posexplode("top_products").alias("_pos", "_p")).select(
        "db", (F.col("_pos") + 1).alias("rank"), F.col("_p.product_code").alias("product_code"),
        F.col("_p.product_name").alias("product_name"), F.col("_p.quantity").alias("quantity"),
        F.col("_p.revenue").alias("revenue"))
