"""Projection, point and list reads (O-10..O-26).

Generic list queries take the same filter shapes the ERP clients accept (a
dict of equalities or ``[op, value]`` pairs, or a list of ``[field, op, value]``
triples) and turn them into Column predicates, so Catalyst pushes them into the
scan. Every ordering ends in a unique key, so pages are deterministic.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterable, Mapping, Sequence
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerflow import functions as lf
from ledgerflow.constants import (
    CRM_LEADS_LIMIT, CUSTOMER_MOVE_TYPES, CUSTOMER_SEARCH_LIMIT, DRAFT, LIST_PAGE_LENGTH, OVERDUE_LIMIT,
    PENDING_LIMIT, RECENT_AUDIT_LIMIT, UNKNOWN_PARTNER,
)
from ledgerflow.operators.metrics import overdue_core
from ledgerflow.operators.ordering import SortKey, after as behind, columns_of, last_key
from ledgerflow.operators.topk import company_keys, lookup, row_bound, top_k, top_k_per_group
from ledgerflow.sources.tables import allowed

# --- filters -------------------------------------------------------------------------------------

OPERATORS = ("=", "!=", "like", "not like", "ilike", "not ilike", ">", ">=", "<", "<=", "in", "not in")


def predicate(field: str, op: str, value: Any, case_insensitive_like: bool = True) -> Column:
    """One ``field op value`` condition as a Column.

    A row without a value passes every negative operator (``!=``, ``not in``, ``not like``) and
    no other one; comparing with ``None`` by ``=`` or ``!=`` tests for a missing value."""
    c = F.col(field)
    op = op.strip().lower()
    if op in ("=", "=="):
        return c.isNull() if value is None else c == F.lit(value)
    if op in ("!=", "<>"):
        return c.isNotNull() if value is None else (c != F.lit(value)) | c.isNull()
    if op in ("like", "not like", "ilike", "not ilike"):
        ci = case_insensitive_like or op.endswith("ilike")
        pattern = str(value).replace("\\", "\\\\")  # a backslash is an ordinary character
        cond = F.lower(c).like(pattern.lower()) if ci else c.like(pattern)
        return ~cond | c.isNull() if op.startswith("not") else cond
    if op == ">":
        return c > F.lit(value)
    if op == ">=":
        return c >= F.lit(value)
    if op == "<":
        return c < F.lit(value)
    if op == "<=":
        return c <= F.lit(value)
    if op in ("in", "not in"):
        vals = list(value) if not isinstance(value, str) else [v.strip() for v in value.split(",")]
        return ~c.isin(vals) | c.isNull() if op == "not in" else c.isin(vals)
    raise ValueError(f"unsupported filter operator {op!r}; supported: {OPERATORS}")


def filters_to_column(filters: dict | Sequence | None, case_insensitive_like: bool = True) -> Column | None:
    """Combine list-query filters with AND; ``None`` or empty means no filter."""
    if not filters:
        return None
    conds: list[Column] = []
    if isinstance(filters, dict):
        for field, v in filters.items():
            if isinstance(v, (list, tuple)) and len(v) == 2 and isinstance(v[0], str) and v[0].lower() in OPERATORS:
                conds.append(predicate(field, v[0], v[1], case_insensitive_like))
            else:
                conds.append(predicate(field, "=", v, case_insensitive_like))
    else:
        for t in filters:
            t = list(t)
            if len(t) == 4:  # [doctype, field, op, value]
                t = t[1:]
            field, op, value = t
            conds.append(predicate(field, op, value, case_insensitive_like))
    out = conds[0]
    for c in conds[1:]:
        out = out & c
    return out


def order_keys(order_by: str | Sequence[str] | None, tie_break: Sequence[str] = ()) -> list[SortKey]:
    """``"creation desc, name"`` style ordering plus unique tie-break columns."""
    if order_by is None:
        items: list[str] = []
    elif isinstance(order_by, str):
        items = [x.strip() for x in order_by.split(",") if x.strip()]
    else:
        items = list(order_by)
    keys, seen = [], set()
    for it in items:
        parts = it.split()
        name, direction = parts[0], (parts[1].lower() if len(parts) > 1 else "asc")
        seen.add(name)
        keys.append(SortKey(name, direction == "desc"))
    keys.extend(SortKey(t) for t in tie_break if t not in seen)
    return keys


def order_columns(order_by: str | Sequence[str] | None, tie_break: Sequence[str] = ()) -> list[Column]:
    return columns_of(order_keys(order_by, tie_break))


# O-12 / O-13 --------------------------------------------------------------------------------------

def list_query(df: DataFrame, filters: dict | Sequence | None = None, fields: Sequence[str] | None = None,
               order_by: str | Sequence[str] | None = None, start: int = 0,
               length: int | None = LIST_PAGE_LENGTH, key: Sequence[str] = ("name",),
               case_insensitive_like: bool = True, after: Mapping[str, Any] | None = None) -> DataFrame:
    """Filter, order, page and project a table.

    ``length=None`` (or 0) returns every match; ``key`` is the unique tie-break
    appended to the ordering so that pages never overlap. A page starts at the row number ``start`` or, cheaper,
    behind the row whose order columns and key are ``after`` (``next_page`` gives them for a page)."""
    cond = filters_to_column(filters, case_insensitive_like)
    out = df.filter(cond) if cond is not None else df
    tie = [k for k in key if k in df.columns]
    if (length or start or after) and not tie:
        raise ValueError(f"paging needs a unique key; the table has none of {tuple(key)}")
    order = order_keys(order_by, tie)
    if after is not None:
        if start:
            raise ValueError("a page starts at a number or behind a key, not both")
        out = out.where(behind(out, order, after))
    if length or start:
        out = top_k(out, order, length or None, start)
    elif order_by:
        out = out.orderBy(*columns_of(order))
    return out.select(*fields) if fields else out


def next_page(page: DataFrame, order_by: str | Sequence[str] | None = None, key: Sequence[str] = ("name",)) -> dict[str, Any] | None:
    """What ``list_query`` takes as ``after`` for the page that follows ``page`` (None: there was no row).

    The page must hold the columns of its order and key."""
    return last_key(page, order_keys(order_by, [k for k in key if k in page.columns]))


def search(df: DataFrame, filters=None, fields=None, order=None, offset: int = 0, limit: int | None = None,
           key: Sequence[str] = ("id",), after: Mapping[str, Any] | None = None) -> DataFrame:
    """O-13 search / search_read: like ``list_query`` with ``limit``/``offset``; a falsy limit means all rows."""
    return list_query(df, filters, fields, order, offset, limit or None, key, after=after)


# O-15
def count_query(df: DataFrame, filters: dict | Sequence | None = None) -> DataFrame:
    cond = filters_to_column(filters)
    out = df.filter(cond) if cond is not None else df
    return out.agg(F.count(F.lit(1)).alias("count"))


# O-11 / O-14 ------------------------------------------------------------------------------------

#: Ranges that a table of ids is described by, for a table clustered on the id, and tiles that they are made of.
ID_RANGES, ID_TILES = 32, 256


def id_ranges(ids: DataFrame, key: str, ranges: int = ID_RANGES, tiles: int = ID_TILES) -> Column:
    """The ranges of ``key`` that hold the ids: up to ``ranges`` of them for numbers, one for other types.

    Two aggregations over the ids (of one and of ``tiles`` rows): tiles of about as many ids, each with its least and
    largest id, are joined where the gap between them is not among the largest. So what lies between old ids and new
    ones, say, is not read."""
    c = F.col(key)
    if not isinstance(ids.schema[key].dataType, T.IntegralType):
        lo, hi = ids.agg(F.min(key), F.max(key)).first()
        return F.lit(False) if lo is None else (c >= F.lit(lo)) & (c <= F.lit(hi))
    cuts = ids.agg(F.percentile_approx(key, [i / tiles for i in range(1, tiles)])).first()[0]
    if not cuts:
        return F.lit(False)
    tile = F.size(F.filter(F.array(*[F.lit(x) for x in sorted(set(cuts))]), lambda x: x < c))
    found = [(r["lo"], r["hi"]) for r in ids.where(c.isNotNull()).groupBy(tile.alias("_tile")).agg(
        F.min(key).alias("lo"), F.max(key).alias("hi")).collect()]
    found.sort()
    gaps = sorted((b[0] - a[1] for a, b in zip(found, found[1:])), reverse=True)
    least = gaps[ranges - 2] if len(gaps) >= ranges else 0
    joined = [list(found[0])]
    for lo, hi in found[1:]:
        if lo - joined[-1][1] > least and len(joined) < ranges:
            joined.append([lo, hi])
        else:
            joined[-1][1] = hi
    out = None
    for lo, hi in joined:
        inside = (c >= F.lit(lo)) & (c <= F.lit(hi))
        out = inside if out is None else out | inside
    return out


def _id_filter(df: DataFrame, ids, key: str, clustered: bool = False) -> DataFrame:
    """Rows of ``df`` that ``ids`` names. ``clustered``: the table is stored in the order of ``key``, so the ranges of
    the ids are pushed into its scan first (files and row groups between them are skipped)."""
    if ids is None:
        return df
    if isinstance(ids, DataFrame):
        if clustered:
            df = df.where(id_ranges(ids if key in ids.columns else ids.select(F.col(ids.columns[0]).alias(key)), key))
        # distinct() is a partial aggregate: a key repeated a million times reaches the
        # semi-join as one row, so the key side of the join is never skewed.
        shared = [c for c in ids.columns if c in df.columns]
        if shared:
            return df.join(ids.select(*shared).distinct(), shared, "left_semi")
        return df.join(ids.select(F.col(ids.columns[0]).alias(key)).distinct(), key, "left_semi")
    return df.filter(F.col(key).isin(list(ids)))


def read_records(df: DataFrame, ids=None, fields: Sequence[str] | None = None, key: str = "id",
                 clustered: bool = False) -> DataFrame:
    """Rows whose ``key`` is in ``ids`` (a list or a one-column DataFrame), projected on ``fields``.

    A DataFrame of ids is a left-semi join, so ids may be as many as the table; on a table stored in the order of
    the key (``write_company_table`` with it in ``cluster_by``) ``clustered`` reads only the ids' ranges."""
    out = _id_filter(df, ids, key, clustered)
    if fields:
        keep = [key] + [f for f in fields if f != key]
        if "db" in df.columns and "db" not in keep:
            keep = ["db"] + keep
        out = out.select(*keep)
    return out


def get_doc(df: DataFrame, names, fields: Sequence[str] | None = None, key: str = "name", clustered: bool = False) -> DataFrame:
    """Documents by name; names that do not exist give no row (an empty result, not an error)."""
    if isinstance(names, str):
        names = [names]
    return read_records(df, names, fields, key, clustered)


# presets O-16..O-22 -----------------------------------------------------------------------------

LEAD_FIELDS = ("name", "lead_name", "company_name", "status", "source", "creation")
CUSTOMER_FIELDS = ("name", "customer_name", "customer_group", "territory", "customer_type", "default_currency")
CUSTOMER_SEARCH_FIELDS = ("name", "customer_name", "customer_group", "territory")
SALES_ORDER_FIELDS = ("name", "customer", "transaction_date", "grand_total", "status", "delivery_status")
SALES_INVOICE_FIELDS = ("name", "customer", "posting_date", "grand_total", "outstanding_amount", "status")
EXPENSE_FIELDS = ("name", "state", "total_amount", "employee_id", "employee_name", "date", "description")
LEAVE_FIELDS = ("display_name", "state", "employee_id", "employee_name", "date_from", "date_to",
                "number_of_days", "holiday_status_name")


def crm_leads(leads: DataFrame, status: str | None = None, limit: int = CRM_LEADS_LIMIT) -> DataFrame:
    return list_query(leads, {"status": status} if status else None, LEAD_FIELDS, "creation desc", 0, limit)


def customer_detail(customers: DataFrame, names) -> DataFrame:
    return get_doc(customers, names, CUSTOMER_FIELDS)


def search_customers(customers: DataFrame, query: str, limit: int = CUSTOMER_SEARCH_LIMIT,
                     case_insensitive: bool = True) -> DataFrame:
    return list_query(customers, [["customer_name", "like", f"%{query}%"]], CUSTOMER_SEARCH_FIELDS, None, 0, limit,
                      case_insensitive_like=case_insensitive)


def order_with_lines(orders: DataFrame, items: DataFrame, names=None) -> DataFrame:
    """O-19: sales orders with their item rows, one row per item (header columns repeated).

    Flat rather than nested, so an order with very many lines never becomes a
    single array value in one task."""
    heads = get_doc(orders, names) if names is not None else orders
    lines = items.withColumnRenamed("parent", "name")
    # Inner join (AQE may split a hot order on either side) plus the orders without
    # lines (anti-join against the distinct parents) instead of one left join, whose
    # line side could not be split.
    with_lines = heads.join(lines, "name", "inner")
    bare = heads.join(lines.select("name").distinct(), "name", "left_anti")
    for f in lines.schema.fields:
        if f.name != "name":
            bare = bare.withColumn(f.name, F.lit(None).cast(f.dataType))
    return with_lines.unionByName(bare)


def sales_orders(orders: DataFrame, status: str | None = None, customer: str | None = None,
                 limit: int = LIST_PAGE_LENGTH) -> DataFrame:
    f: dict[str, Any] = {"docstatus": ["!=", 2]}
    if status:
        f["status"] = status
    if customer:
        f["customer"] = customer
    return list_query(orders, f, SALES_ORDER_FIELDS, "transaction_date desc", 0, limit)


def sales_invoice(invoices: DataFrame, names) -> DataFrame:
    return get_doc(invoices, names)


def sales_invoices(invoices: DataFrame, status: str | None = None, customer: str | None = None,
                   is_return: bool = False, limit: int = LIST_PAGE_LENGTH) -> DataFrame:
    f: dict[str, Any] = {"docstatus": 1, "is_return": 1 if is_return else 0}
    if status:
        f["status"] = status
    if customer:
        f["customer"] = customer
    return list_query(invoices, f, SALES_INVOICE_FIELDS, "posting_date desc", 0, limit)


# O-10 / O-23 / O-24 -----------------------------------------------------------------------------

def invoice_detail(moves: DataFrame, partners: DataFrame, currencies: DataFrame, ids=None,
                   dbs: Iterable[str] | None = None, clustered: bool = False) -> DataFrame:
    """Invoices with partner and currency (13 columns + ``db``); ``ids`` optionally narrows them (``clustered``: see
    ``read_records``)."""
    m = _id_filter(allowed(moves, dbs), ids, "id", clustered)
    bounded = row_bound(len(list(ids)), dbs) if ids is not None and not isinstance(ids, DataFrame) else None
    m = lookup(m, partners, company_keys("partner_id", partners), {"name": "partner_name", "id": "_pid"}, bounded)
    m = lookup(m, currencies, [("currency_id", "id")], {"symbol": "currency_symbol"}, bounded)
    return m.select(
        "db", "id", "name", "state", "move_type",
        lf.money_out("amount_total").alias("amount_total"), lf.money_out("amount_residual").alias("amount_residual"),
        "currency_id", "date", "invoice_date", "invoice_date_due", "partner_name", F.col("_pid").alias("partner_id"),
        "currency_symbol",
    )


def pending_core(moves: DataFrame, state: str = DRAFT, limit: int | None = PENDING_LIMIT,
                 dbs: Iterable[str] | None = None, ranked: bool = True) -> DataFrame:
    """Customer moves in ``state``, newest first per company (nulls first, as PostgreSQL sorts DESC);
    ``limit=None`` keeps all (``ranked=False`` then skips the ranking)."""
    cand = allowed(moves, dbs).filter((F.col("state") == state) & lf.in_set("move_type", CUSTOMER_MOVE_TYPES))
    return top_k_per_group(cand, ["db"], [SortKey("create_date", True, nulls_first=True), SortKey("id")], limit,
                           "rank" if ranked or limit is not None else None)


def pending_invoices(moves: DataFrame, partners: DataFrame, state: str = DRAFT, limit: int | None = PENDING_LIMIT,
                     dbs: Iterable[str] | None = None) -> DataFrame:
    core = pending_core(moves, state, limit, dbs)
    out = lookup(core, partners, company_keys("partner_id", partners), {"name": "partner_name"}, row_bound(limit, dbs))
    return out.select("db", "rank", "id", "name", "state", lf.money_out("amount_total").alias("amount_total"),
                      "create_date", "partner_name")


def overdue_invoices(moves: DataFrame, partners: DataFrame, currencies: DataFrame, as_of: dt.date | str,
                     threshold_days: int = 0, limit: int | None = OVERDUE_LIMIT,
                     dbs: Iterable[str] | None = None) -> DataFrame:
    """O-24: overdue customer invoices per company, worst first, with partner and currency."""
    core = overdue_core(moves, as_of, threshold_days, limit, dbs)
    bounded = row_bound(limit, dbs)
    out = lookup(core, partners, company_keys("partner_id", partners), {"name": "_pname"}, bounded)
    out = lookup(out, currencies, [("currency_id", "id")], {"symbol": "_sym"}, bounded)
    return out.select(
        "db", "rank", "id", "name", "state",
        lf.default_text("_pname", UNKNOWN_PARTNER).alias("partner_name"),
        lf.money_out("amount_total").alias("amount_total"), lf.money_out("amount_residual").alias("amount_residual"),
        F.col("invoice_date_due").alias("date_due"), "days_overdue",
        lf.currency_of("_sym").alias("currency"),
    )


# O-25
def recent_audit(audit: DataFrame, action_type: str | None = None, actor: str | None = None,
                 limit: int | None = RECENT_AUDIT_LIMIT, day_col: str = "created_date") -> DataFrame:
    """Newest audit rows, optionally for one action type and/or actor (a global top-k).

    On the day-partitioned audit table (``day_col`` present) a first, narrow pass
    counts matching rows per day; the top-k then reads only the newest days that
    hold ``limit`` rows (partition pruning), instead of every column of every day."""
    cond = F.lit(True)
    if action_type:
        cond = cond & (F.col("action_type") == action_type)
    if actor:
        cond = cond & (F.col("actor") == actor)
    rows = audit.filter(cond)
    if limit is not None and day_col in audit.columns:
        per_day = rows.filter(F.col(day_col).isNotNull()).groupBy(day_col).agg(F.count(F.lit(1)).alias("_n"))
        # one row per day: a single-partition running sum is bounded by the number of days
        newest = Window.orderBy(F.col(day_col).desc()).rowsBetween(Window.unboundedPreceding, 0)
        cut = (per_day.withColumn("_cum", F.sum("_n").over(newest))
               .filter(F.col("_cum") - F.col("_n") < int(limit))
               .agg(F.min(day_col).alias("d"), F.max("_cum").alias("covered")).first())
        if cut is not None and cut["covered"] is not None and cut["covered"] >= int(limit):
            rows = rows.filter(F.col(day_col) >= F.lit(cut["d"]))
    return top_k(rows, [SortKey("created_at", True), SortKey("id", True)], limit)


# O-26
def read_expenses(expenses: DataFrame, ids=None) -> DataFrame:
    return read_records(expenses, ids, EXPENSE_FIELDS)


def read_leaves(leaves: DataFrame, ids=None) -> DataFrame:
    return read_records(leaves, ids, LEAVE_FIELDS)
