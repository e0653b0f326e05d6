"""Random filter sets of the list grammar against the same conditions in DuckDB SQL."""

from __future__ import annotations

import random

from ledgerflow.operators import lists as ls
from ledgerflow.sources.fixtures import duckdb_cte, fixtures

from __spark_entry__ import SMOKE_DIR

FIELDS = {
    "status": ["Draft", "Completed", "To Deliver and Bill", "Nope"],
    "delivery_status": ["Fully Delivered", "Not Delivered"],
    "docstatus": [0, 1, 2],
    "grand_total": [50_000_000, 150_000_000, 300_000_000],
    "customer": ["CUST-000001", "%0001%", "%00%1", "cust-%"],
}


def _sql(field, op, value):
    def lit(v):
        return f"'{v}'" if isinstance(v, str) else str(v)

    if op == "=":
        return f"{field} = {lit(value)}"
    if op == "!=":
        return f"({field} <> {lit(value)} OR {field} IS NULL)"
    if op in ("like", "not like"):
        cond = f"lower({field}) LIKE lower({lit(value)})"
        return f"NOT ({cond})" if op == "not like" else cond
    if op in ("in", "not in"):
        inner = ", ".join(lit(v) for v in value)
        return f"{field} {'NOT IN' if op == 'not in' else 'IN'} ({inner})"
    return f"{field} {op} {lit(value)}"


def _random_filter(rng):
    field = rng.choice(list(FIELDS))
    vals = FIELDS[field]
    if field == "customer":
        op = rng.choice(["like", "not like", "=", "!="])
    elif field in ("grand_total", "docstatus"):
        op = rng.choice(["=", "!=", ">", ">=", "<", "<=", "in", "not in"])
    else:
        op = rng.choice(["=", "!=", "in", "not in"])
    value = rng.sample(vals, 2) if op in ("in", "not in") else rng.choice(vals)
    return [field, op, value]


def test_random_filters_match_sql(spark, duck):
    rng = random.Random(2024)
    table = fixtures(spark, SMOKE_DIR)["frappe_sales_order"]
    cte = duckdb_cte(["frappe_sales_order"])
    for _ in range(12):
        flt = [_random_filter(rng) for _ in range(rng.randint(1, 3))]
        got = sorted(r.name for r in ls.list_query(table, flt, ["name"], length=None).collect())
        where = " AND ".join(_sql(*f) for f in flt)
        want = sorted(r[0] for r in duck.execute(f"{cte} SELECT name FROM frappe_sales_order WHERE {where}").fetchall())
        assert got == want, flt
