"""Sales, product, customer and backlog metrics for all companies at once (O-40..O-49, O-54).

Plans are written so that every scan is pruned before the shuffle: date ranges
push into Parquet, aggregations are partial per task (a company or partner
holding a third of all rows collapses to one row per task before the exchange),
and dimension joins run on the bounded aggregate or top-k output.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerflow import functions as lf
from ledgerflow.constants import (
    CURRENCY_CODE, CUSTOMER_MOVE_TYPES, DRAFT_ORDER_STATE, HIGH_AMOUNT, MEDIUM_AMOUNT, OVERDUE_LIMIT,
    PENDING_DELIVERY_STATES, POSTED, RISK_HIGH_COUNT, RISK_MEDIUM_COUNT, SALE_STATES, SEVERE_OVERDUE_DAYS,
    TOP_PRODUCTS_LIMIT, UNKNOWN_PARTNER,
)
from ledgerflow.operators.ordering import SortKey
from ledgerflow.operators.topk import company_keys, lookup, top_k_per_group, row_bound
from ledgerflow.sources.tables import allowed, company_spine, per_company

def _zero() -> F.Column:
    return F.lit(0).cast("decimal(18,2)")


def _spine_join(df: DataFrame, agg: DataFrame, dbs: Iterable[str] | None) -> DataFrame:
    # agg has at most one row per allowed company: its size is bounded by the company list.
    return company_spine(df.sparkSession, dbs).join(F.broadcast(agg), "db", "left")


def _avg(total: F.Column, count: F.Column) -> F.Column:
    return F.when(count > 0, total.cast("double") / count).otherwise(F.lit(0.0))


def _sales_pass(orders: DataFrame, as_of: dt.date | str, period: str, dbs: Iterable[str] | None,
                with_prev: bool, tz: str | None = None) -> DataFrame:
    """One scan: completed-order count and revenue in the period and, optionally, the previous day's revenue."""
    orders = allowed(orders, dbs)
    cur_lo, cur_hi = lf.period_bounds(as_of, period)
    lo = lf.period_bounds(as_of, "yesterday")[0] if with_prev else cur_lo
    done = orders.filter(lf.in_range("date_order", lo, cur_hi, tz) & lf.in_set("state", SALE_STATES))
    is_cur = lf.in_range("date_order", cur_lo, cur_hi, tz)
    aggs = [lf.count_if(is_cur).alias("_n"), lf.sum_if(is_cur, "amount_total").alias("_sum")]
    if with_prev:
        aggs.append(lf.sum_if(~is_cur, "amount_total").alias("_prev"))
    agg = done.groupBy("db").agg(*aggs)
    out = _spine_join(orders, agg, dbs)
    out = (out.withColumn("_n", F.coalesce(F.col("_n"), F.lit(0)).cast("bigint"))
           .withColumn("_sum", F.coalesce(F.col("_sum"), _zero())))
    if with_prev:
        out = out.withColumn("_prev", F.coalesce(F.col("_prev"), _zero()))
    return out


# O-40 + O-42 in one pass, and O-41
def sales_summary(orders: DataFrame, as_of: dt.date | str, period: str = "today",
                  dbs: Iterable[str] | None = None, compare: bool = True, tz: str | None = None) -> DataFrame:
    """Per company: order count, revenue and average over completed orders in the period.

    ``period='today'`` also compares with the previous day (one scan, two
    conditional sums); ``'mtd'`` covers the whole calendar month of ``as_of``.
    Order times are compared as stored (no zone shift) unless ``tz`` names the
    zone whose days count (order times then read as UTC).
    """
    with_prev = compare and period == "today"
    s = _sales_pass(orders, as_of, period, dbs, with_prev, tz)
    comparison = (lf.change_text("_sum", "_prev") if with_prev else F.lit(None).cast("string"))
    return s.select(
        F.col("db"),
        F.lit(period).alias("period"),
        lf.money_out("_sum").alias("total_revenue"),
        F.col("_n").alias("order_count"),
        _avg(F.col("_sum"), F.col("_n")).alias("avg_order_value"),
        F.lit(CURRENCY_CODE).alias("currency"),
        comparison.alias("comparison_previous"),
    )


# O-42 on its own
def sales_comparison(orders: DataFrame, as_of: dt.date | str, period: str = "yesterday",
                     dbs: Iterable[str] | None = None, tz: str | None = None) -> DataFrame:
    """Per company: today's and the previous day's revenue and the signed percent change.

    Any period other than ``yesterday`` answers ``N/A`` (as the reference does)."""
    if period != "yesterday":
        s = _sales_pass(orders, as_of, "today", dbs, False, tz)
        return s.select("db", lf.money_out("_sum").alias("current_revenue"),
                        F.lit(None).cast("double").alias("previous_revenue"), F.lit("N/A").alias("comparison"))
    s = _sales_pass(orders, as_of, "today", dbs, True, tz)
    return s.select("db", lf.money_out("_sum").alias("current_revenue"),
                    lf.money_out("_prev").alias("previous_revenue"),
                    lf.change_text("_sum", "_prev").alias("comparison"))


# O-43
def top_products(lines: DataFrame, orders: DataFrame, products: DataFrame, templates: DataFrame,
                 as_of: dt.date | str, period: str = "today", limit: int | None = TOP_PRODUCTS_LIMIT,
                 dbs: Iterable[str] | None = None, tz: str | None = None) -> DataFrame:
    """Best-selling products per company by revenue over completed orders in the period.

    Lines are aggregated per (company, product) before any dimension join; code
    and name are looked up for the top ``limit`` rows only.
    """
    period = "today" if period == "today" else "mtd"
    sel = (allowed(orders, dbs).filter(lf.in_period("date_order", as_of, period, tz)
                                       & lf.in_set("state", SALE_STATES))
           .select("db", F.col("id").alias("order_id")))
    per_product = (allowed(lines, dbs).join(sel, ["db", "order_id"], "inner")
                   .groupBy("db", "product_id")
                   .agg(F.sum("product_uom_qty").alias("_qty"), F.sum("price_subtotal").alias("_rev")))
    ranked = top_k_per_group(per_product, ["db"], [SortKey("_rev", True), SortKey("product_id")], limit)
    bounded = row_bound(limit, dbs)
    with_code = lookup(ranked, products, company_keys("product_id", products),
                       {"default_code": "product_code", "product_tmpl_id": "_tmpl"}, bounded)
    with_name = lookup(with_code, templates, company_keys("_tmpl", templates), {"name": "product_name"}, bounded)
    return with_name.select(
        "db", "rank", "product_id", "product_code", "product_name",
        lf.money_out("_qty").alias("quantity"), lf.money_out("_rev").alias("revenue"),
    )


def risk_score(total_overdue: F.Column, overdue_count: F.Column) -> F.Column:
    """O-54: high / medium / low on overdue amount or count."""
    return (F.when((total_overdue > HIGH_AMOUNT) | (overdue_count > RISK_HIGH_COUNT), F.lit("high"))
            .when((total_overdue > MEDIUM_AMOUNT) | (overdue_count > RISK_MEDIUM_COUNT), F.lit("medium"))
            .otherwise(F.lit("low")))


def customer_move_totals(moves: DataFrame, as_of: dt.date | str, dbs: Iterable[str] | None = None) -> DataFrame:
    """Receivable and overdue sums per (company, partner) over posted customer moves (partial aggregation)."""
    asof = lf.lit_date(as_of)
    open_ = F.col("amount_residual") > 0
    late = open_ & (F.col("invoice_date_due") < asof)
    return (allowed(moves, dbs)
            .filter((F.col("state") == POSTED) & lf.in_set("move_type", CUSTOMER_MOVE_TYPES))
            .groupBy("db", "partner_id")
            .agg(lf.sum_if(open_, "amount_residual").alias("_recv"),
                 lf.sum_if(late, "amount_residual").alias("_over"),
                 lf.count_if(late).alias("_n_over")))


# O-44 + O-54
def customer_risk(moves: DataFrame, partners: DataFrame, as_of: dt.date | str,
                  customer_ids: Iterable[int] | DataFrame | None = None,
                  dbs: Iterable[str] | None = None) -> DataFrame:
    """Risk snapshot for every partner of every company (partners without moves report zeros)."""
    spine = per_company(partners.select("id", "name", *(["db"] if "db" in partners.columns else [])), dbs)
    totals = customer_move_totals(moves, as_of, dbs)
    if customer_ids is not None:
        if isinstance(customer_ids, DataFrame):
            ids = customer_ids.select(F.col(customer_ids.columns[0]).alias("id")).distinct()
            spine = spine.join(ids, "id", "left_semi")
            totals = totals.join(ids.withColumnRenamed("id", "partner_id"), "partner_id", "left_semi")
        else:
            id_list = [int(x) for x in customer_ids]
            spine = spine.filter(F.col("id").isin(id_list))
            totals = totals.filter(F.col("partner_id").isin(id_list))
    j = spine.join(totals, (spine["db"] == totals["db"]) & (spine["id"] == totals["partner_id"]), "left")
    over = F.coalesce(totals["_over"], _zero())
    n_over = F.coalesce(totals["_n_over"], F.lit(0)).cast("bigint")
    return j.select(
        spine["db"],
        spine["id"].alias("customer_id"),
        lf.default_text(spine["name"], UNKNOWN_PARTNER).alias("customer_name"),
        lf.money_out(F.coalesce(totals["_recv"], _zero())).alias("total_receivable"),
        lf.money_out(over).alias("total_overdue"),
        n_over.alias("overdue_count"),
        F.lit(0.0).alias("avg_days_to_pay"),
        F.lit(None).cast("date").alias("last_payment_date"),
        risk_score(over, n_over).alias("risk_score"),
    )


def _count_on_spine(df: DataFrame, cond: F.Column, name: str, dbs: Iterable[str] | None) -> DataFrame:
    agg = allowed(df, dbs).filter(cond).groupBy("db").agg(F.count(F.lit(1)).alias("_n"))
    return _spine_join(df, agg, dbs).select("db", F.coalesce(F.col("_n"), F.lit(0)).cast("bigint").alias(name))


# O-45
def pending_orders(orders: DataFrame, dbs: Iterable[str] | None = None) -> DataFrame:
    return _count_on_spine(orders, F.col("state") == DRAFT_ORDER_STATE, "pending_orders", dbs)


# O-46
def pending_deliveries(pickings: DataFrame, dbs: Iterable[str] | None = None) -> DataFrame:
    return _count_on_spine(pickings, lf.in_set("state", PENDING_DELIVERY_STATES), "pending_deliveries", dbs)


# O-24 core (decimal amounts); shaped by worklists/lists
def overdue_core(moves: DataFrame, as_of: dt.date | str, threshold_days: int = 0,
                 limit: int | None = OVERDUE_LIMIT, dbs: Iterable[str] | None = None,
                 ranked: bool = True) -> DataFrame:
    """Posted customer moves with a residual, due strictly before ``as_of - threshold_days``,
    ranked worst first per company (``days_overdue desc, id``); ``limit=None`` keeps all
    (``ranked=False`` then skips the ranking)."""
    if int(threshold_days) < 0:
        raise ValueError("threshold_days must be >= 0")
    d = lf.as_date(as_of)
    cutoff = d - dt.timedelta(days=int(threshold_days))
    late = (allowed(moves, dbs)
            .filter((F.col("state") == POSTED) & lf.in_set("move_type", CUSTOMER_MOVE_TYPES)
                    & (F.col("amount_residual") > 0) & (F.col("invoice_date_due") < lf.lit_date(cutoff)))
            .withColumn("days_overdue", F.datediff(lf.lit_date(d), F.col("invoice_date_due"))))
    return top_k_per_group(late, ["db"], [SortKey("days_overdue", True), SortKey("id")], limit,
                           "rank" if ranked or limit is not None else None)


# O-47 + O-48
def overdue_summary(moves: DataFrame, as_of: dt.date | str, threshold_days: int = 0,
                    limit: int | None = None, dbs: Iterable[str] | None = None) -> DataFrame:
    """Count and total of the overdue list per company, plus the part more than 30 days late.

    The totals are true by default; with a ``limit`` they cover the rows of a list
    cut at so many per company, as a list report shows them."""
    core = overdue_core(moves, as_of, threshold_days, limit, dbs, ranked=False)
    severe = F.col("days_overdue") > SEVERE_OVERDUE_DAYS
    agg = core.groupBy("db").agg(
        F.count(F.lit(1)).alias("_n"), F.sum("amount_residual").alias("_total"),
        lf.count_if(severe).alias("_n_severe"), lf.sum_if(severe, "amount_residual").alias("_severe"),
    )
    return _spine_join(moves, agg, dbs).select(
        "db",
        F.coalesce(F.col("_n"), F.lit(0)).cast("bigint").alias("overdue_count"),
        lf.money_out(F.coalesce(F.col("_total"), _zero())).alias("total_overdue_amount"),
        F.coalesce(F.col("_n_severe"), F.lit(0)).cast("bigint").alias("severe_overdue_count"),
        lf.money_out(F.coalesce(F.col("_severe"), _zero())).alias("severe_overdue_amount"),
    )
