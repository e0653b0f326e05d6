"""Work lists and object contexts (O-49, O-55, O-56, O-57a-c)."""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerflow import functions as lf
from ledgerflow.constants import (
    DEFAULT_LEAVE_TYPE, DRAFT, EXPENSE_ACTIONABLE_STATES, FULL_ACTIONS, HIGH_AMOUNT, INVOICE_ACTIONABLE_STATES,
    INVOICE_VIEW_ONLY_STATES, LEAVE_ACTIONABLE_STATES, MANAGER_ROLE, MEDIUM_AMOUNT, OVERDUE_CRITICAL_DAYS,
    OVERDUE_HIGH_DAYS, OVERDUE_MEDIUM_DAYS, PENDING_HIGH_DAYS, PENDING_MEDIUM_DAYS, POSTED, UNKNOWN_PARTNER,
    VIEW_ACTIONS, WORKLIST_LIMIT, WORKLIST_OVERDUE_THRESHOLD,
)
from ledgerflow.operators.lists import _id_filter, pending_core
from ledgerflow.operators.metrics import overdue_core
from ledgerflow.operators.topk import company_keys, lookup, row_bound
from ledgerflow.sources.tables import allowed, company_spine


def pending_priority(days: Column, amount: Column) -> Column:
    return (F.when((days > PENDING_HIGH_DAYS) | (amount > HIGH_AMOUNT), F.lit("high"))
            .when((days > PENDING_MEDIUM_DAYS) | (amount > MEDIUM_AMOUNT), F.lit("medium"))
            .otherwise(F.lit("low")))


def overdue_priority(days: Column, amount: Column) -> Column:
    return (F.when((days > OVERDUE_CRITICAL_DAYS) | (amount > HIGH_AMOUNT), F.lit("critical"))
            .when((days > OVERDUE_HIGH_DAYS) | (amount > MEDIUM_AMOUNT), F.lit("high"))
            .when(days > OVERDUE_MEDIUM_DAYS, F.lit("medium"))
            .otherwise(F.lit("low")))


def _item(object_type: str, id_col: str, name_col: str, amount: Column, since: Column, days: Column,
          priority: Column) -> list[Column]:
    return [
        F.col("db"), F.col("rank"),
        F.lit(object_type).alias("object_type"),
        F.col(id_col).cast("string").alias("object_id"),
        lf.display_name(name_col, object_type.capitalize(), id_col).alias("display_name"),
        lf.money_out(amount).alias("amount"),
        since.alias("waiting_since"),
        days.alias("days_pending"),
        priority.alias("priority"),
        F.lit(None).cast("string").alias("assignee"),
    ]


# O-55
def pending_approvals(moves: DataFrame, as_of: dt.date | str, limit: int | None = WORKLIST_LIMIT,
                      dbs: Iterable[str] | None = None) -> DataFrame:
    """Draft customer invoices awaiting approval, newest first per company, with days pending and priority.

    A missing creation time counts as waiting since ``as_of`` (0 days)."""
    core = pending_core(moves, DRAFT, limit, dbs)
    since = F.coalesce(F.col("create_date"), lf.lit_ts_ntz(as_of))
    days = F.datediff(lf.lit_date(as_of), F.to_date(since))
    amount = F.col("amount_total")
    return core.select(*_item("invoice", "id", "name", amount, since, days, pending_priority(days, amount)))


# O-56
def overdue_items(moves: DataFrame, as_of: dt.date | str, threshold_days: int = WORKLIST_OVERDUE_THRESHOLD,
                  limit: int | None = WORKLIST_LIMIT, dbs: Iterable[str] | None = None) -> DataFrame:
    """Invoices more than ``threshold_days`` overdue, worst first per company, with priority."""
    core = overdue_core(moves, as_of, threshold_days, limit, dbs)
    since = F.coalesce(F.col("invoice_date_due").cast("timestamp_ntz"), lf.lit_ts_ntz(as_of))
    days = F.col("days_overdue")
    amount = F.col("amount_residual")
    return core.select(*_item("invoice", "id", "name", amount, since, days, overdue_priority(days, amount)))


# O-49
def pending_item_counts(moves: DataFrame, as_of: dt.date | str, limit: int | None = None,
                        dbs: Iterable[str] | None = None) -> DataFrame:
    """Item counts of both work lists per company; with a ``limit``, as lists cut at it report them.

    Plain counts: nothing is ranked to be counted."""
    a = pending_core(moves, DRAFT, None, dbs, ranked=False).groupBy("db").agg(F.count(F.lit(1)).alias("_a"))
    late = overdue_core(moves, as_of, WORKLIST_OVERDUE_THRESHOLD, None, dbs, ranked=False)
    o = late.groupBy("db").agg(F.count(F.lit(1)).alias("_o"))
    # Both sides hold at most one row per allowed company.
    spine = company_spine(moves.sparkSession, dbs)
    j = spine.join(F.broadcast(a), "db", "left").join(F.broadcast(o), "db", "left")

    def cut(c: str) -> Column:
        n = F.coalesce(c, F.lit(0)).cast("bigint")
        return n if limit is None else F.least(n, F.lit(int(limit)).cast("bigint"))

    return j.select("db", cut("_a").alias("pending_approvals_count"), cut("_o").alias("overdue_items_count"))


def _actions(state: Column, actionable: Iterable[str], view_only: Iterable[str] | None) -> Column:
    full = F.array(*[F.lit(a) for a in FULL_ACTIONS])
    view = F.array(*[F.lit(a) for a in VIEW_ACTIONS])
    expr = F.when(state.isin(list(actionable)), full)
    if view_only is None:
        return expr.otherwise(view)
    return expr.when(state.isin(list(view_only)), view).otherwise(F.array().cast("array<string>"))


# O-57a
def invoice_context(moves: DataFrame, partners: DataFrame, as_of: dt.date | str, ids=None,
                    dbs: Iterable[str] | None = None) -> DataFrame:
    """Context of each invoice: actions offered by state, role needed, days overdue when posted."""
    m = _id_filter(allowed(moves, dbs), ids, "id")
    # A list of ids bounds the rows (one per id and company); a table of ids or none does not.
    bounded = row_bound(len(list(ids)), dbs) if ids is not None and not isinstance(ids, DataFrame) else None
    m = lookup(m, partners, company_keys("partner_id", partners), {"name": "_pname"}, bounded)
    state = F.col("state")
    overdue = F.when((state == POSTED) & F.col("invoice_date_due").isNotNull(),
                     F.greatest(F.lit(0), F.datediff(lf.lit_date(as_of), F.col("invoice_date_due")))).otherwise(0)
    return m.select(
        "db", F.lit("invoice").alias("object_type"), F.col("id").cast("string").alias("object_id"),
        lf.display_name("name", "Invoice", "id").alias("display_name"),
        state.alias("state"),
        lf.money_out("amount_total").alias("amount"),
        lf.default_text("_pname", UNKNOWN_PARTNER).alias("partner"),
        F.col("invoice_date_due").alias("due_date"),
        overdue.alias("days_overdue"),
        _actions(state, INVOICE_ACTIONABLE_STATES, INVOICE_VIEW_ONLY_STATES).alias("available_actions"),
        F.when(state.isin(list(INVOICE_ACTIONABLE_STATES)), F.lit(MANAGER_ROLE)).alias("requires_role"),
        F.struct(lf.money_out("amount_residual").alias("amount_residual"),
                 F.coalesce(F.col("move_type"), F.lit("")).alias("move_type")).alias("additional_info"),
    )


# O-57b
def expense_context(expenses: DataFrame, ids=None, dbs: Iterable[str] | None = None) -> DataFrame:
    e = _id_filter(allowed(expenses, dbs), ids, "id")
    state = F.col("state")
    return e.select(
        "db", F.lit("expense").alias("object_type"), F.col("id").cast("string").alias("object_id"),
        lf.display_name("name", "Expense", "id").alias("display_name"),
        state.alias("state"),
        lf.money_out("total_amount").alias("amount"),
        lf.default_text("employee_name", UNKNOWN_PARTNER).alias("partner"),
        F.lit(None).cast("date").alias("due_date"),
        F.lit(0).alias("days_overdue"),
        _actions(state, EXPENSE_ACTIONABLE_STATES, None).alias("available_actions"),
        F.when(state.isin(list(EXPENSE_ACTIONABLE_STATES)), F.lit(MANAGER_ROLE)).alias("requires_role"),
        F.struct(F.coalesce(F.col("description"), F.lit("")).alias("description")).alias("additional_info"),
    )


# O-57c
def leave_context(leaves: DataFrame, ids=None, dbs: Iterable[str] | None = None) -> DataFrame:
    lv = _id_filter(allowed(leaves, dbs), ids, "id")
    state = F.col("state")
    return lv.select(
        "db", F.lit("leave").alias("object_type"), F.col("id").cast("string").alias("object_id"),
        lf.display_name("display_name", "Leave", "id").alias("display_name"),
        state.alias("state"),
        F.lit(None).cast("double").alias("amount"),
        lf.default_text("employee_name", UNKNOWN_PARTNER).alias("partner"),
        F.lit(None).cast("date").alias("due_date"),
        F.lit(0).alias("days_overdue"),
        _actions(state, LEAVE_ACTIONABLE_STATES, None).alias("available_actions"),
        F.when(state.isin(list(LEAVE_ACTIONABLE_STATES)), F.lit(MANAGER_ROLE)).alias("requires_role"),
        F.struct(
            lf.default_text("holiday_status_name", DEFAULT_LEAVE_TYPE).alias("leave_type"),
            F.coalesce(F.col("number_of_days"), F.lit(0.0)).alias("number_of_days"),
            F.coalesce(F.col("date_from").cast("string"), F.lit("")).alias("date_from"),
            F.coalesce(F.col("date_to").cast("string"), F.lit("")).alias("date_to"),
        ).alias("additional_info"),
    )
