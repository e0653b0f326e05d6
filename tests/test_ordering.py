"""Keyset pages, deep pages and large top-k against plain sorting."""

from __future__ import annotations

import datetime as dt
import random
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from ledgerflow.operators import lists as ls
from ledgerflow.operators import ordering as od
from ledgerflow.operators import topk
from ledgerflow.operators.ordering import SortKey

KINDS = {"i": "bigint", "x": "double", "d": "decimal(18,2)", "s": "string", "day": "date", "t": "timestamp_ntz", "b": "boolean"}


@pytest.fixture(scope="module")
def table(spark):
    rng = random.Random(4)

    def maybe(v):
        return None if rng.random() < 0.15 else v

    rows = []
    for n in range(600):
        x = rng.choice([rng.gauss(0, 1e6), float(rng.randrange(5)), float("nan"), float("inf"), -float("inf")])
        rows.append((f"K{n:04d}", rng.choice(["a", "b", None]), maybe(rng.randrange(-50, 50)), maybe(x), maybe(Decimal(rng.randrange(10**6)) / 100),
                     maybe(rng.choice(["", "é", "abc", f"customer {rng.randrange(30)}", "customer 1 and more"])),
                     maybe(dt.date(1960, 1, 1) + dt.timedelta(days=rng.randrange(40_000))),
                     maybe(dt.datetime(2024, 1, 1) + dt.timedelta(seconds=rng.randrange(10**6), microseconds=rng.randrange(3))),
                     maybe(rng.random() < 0.5)))
    schema = "name string, g string, " + ", ".join(f"{k} {v}" for k, v in KINDS.items())
    return spark.createDataFrame(rows, schema).cache()


@pytest.fixture
def fine(monkeypatch):
    """Ranges so few and thresholds so low that the small table takes several passes."""
    monkeypatch.setattr(od, "RANGES", 4)
    monkeypatch.setattr(od, "ENOUGH", 20)
    monkeypatch.setattr(topk, "DEEP_PAGE", 10)


def names(df):
    return [r["name"] for r in df.select("name").collect()]


ORDERS = [(kind, descending, nulls) for kind in KINDS for descending, nulls in ((False, None), (True, None), (True, True), (False, False))]


@pytest.mark.parametrize("kind,descending,nulls", ORDERS[::5])
def test_deep_pages_and_large_tops(table, fine, kind, descending, nulls):
    keys = [SortKey(kind, descending, nulls), SortKey("name")]
    whole = names(table.orderBy(*od.columns_of(keys)))
    for offset, k in ((0, 300), (100, 20), (590, 50), (255, None)):
        got = names(topk.top_k(table, keys, k, offset))
        assert got == whole[offset:None if k is None else offset + k], (offset, k)


def test_places_far_out_and_in_an_empty_table(table, fine):
    keys = [SortKey("i"), SortKey("name")]
    assert names(topk.top_k(table, keys, 5, 5_000)) == []
    assert names(topk.top_k(table.limit(0), keys, 50, 5)) == []


@pytest.mark.parametrize("kind,descending,nulls", [("i", True, None), ("s", False, False), ("t", True, True)])
def test_top_of_each_group(spark, table, fine, kind, descending, nulls):
    keys = [SortKey(kind, descending, nulls), SortKey("name")]
    old = spark.conf.get("spark.sql.optimizer.windowGroupLimitThreshold", "1000")
    want = sorted((r["g"] or "", r["rank"], r["name"]) for r in topk.top_k_per_group(table, ["g"], keys, 70).collect())
    spark.conf.set("spark.sql.optimizer.windowGroupLimitThreshold", "10")
    try:
        got = topk.top_k_per_group(table, ["g"], keys, 70)
        assert sorted((r["g"] or "", r["rank"], r["name"]) for r in got.collect()) == want and dict(got.dtypes)["rank"] == "int"
    finally:
        spark.conf.set("spark.sql.optimizer.windowGroupLimitThreshold", old)


def test_only_candidates_are_ranked(table, fine):
    rows, base = od.from_to(table, [SortKey("i"), SortKey("name")], 301, 320)
    n = rows.count()
    assert 20 <= n < 150 and base <= 300 < base + n
    few = od.first_of_each(table, ["g"], [SortKey("i", True), SortKey("name")], 30)
    assert 90 <= few.count() < 250


@pytest.mark.parametrize("order", ["i desc, s, name", "s desc, x", "t", "b, day desc", "x desc"])
def test_keyset_pages_walk_through_the_whole_order(table, order):
    small = table.where("name < 'K0110'")
    whole = names(ls.list_query(small, order_by=order, length=None))
    seen, last = [], None
    while True:
        page = ls.list_query(small, order_by=order, length=37, after=last)
        got = names(page)
        if not got:
            break
        seen += got
        last = ls.next_page(page, order)
    assert seen == whole


def test_a_keyset_page_reaches_the_scan(spark):
    from __spark_entry__ import SMOKE_DIR
    from ledgerflow.sources.fixtures import fixtures

    orders = fixtures(spark, SMOKE_DIR)["sale_order"]
    df = ls.search(orders, order="date_order desc", limit=20, after={"date_order": dt.datetime(2001, 7, 1), "id": 5})
    plan = spark._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")
    assert "LessThanOrEqual(o_orderdate,2001-07-01T00:00)" in plan
    with pytest.raises(ValueError):
        ls.search(orders, order="date_order desc", offset=3, limit=20, after={"date_order": None, "id": 5})


def test_deep_page_reads_only_its_dates(spark, fine):
    from __spark_entry__ import SMOKE_DIR
    from ledgerflow.sources.fixtures import fixtures

    orders = fixtures(spark, SMOKE_DIR)["sale_order"]
    rows, base = od.from_to(orders, [SortKey("date_order", True), SortKey("id")], 700, 720)
    plan = spark._jvm.PythonSQLUtils.explainString(rows._jdf.queryExecution(), "formatted")
    assert "LessThanOrEqual(o_orderdate" in plan and "GreaterThanOrEqual(o_orderdate" in plan
    assert base > 500 and rows.count() < 100


def test_bucketed_tables_join_without_an_exchange(spark):
    from __spark_entry__ import SMOKE_DIR
    from ledgerflow.plans.metrics_queries import bucketed_lines_and_orders
    from ledgerflow.sources.fixtures import fixtures
    from ledgerflow.sources.tables import bucket_count, bucketed_table

    assert [bucket_count(x) for x in (0, 1, 256 << 20, (256 << 20) + 1, 10 << 40)] == [1, 1, 1, 2, 65536]
    lines, orders = bucketed_lines_and_orders(fixtures(spark, SMOKE_DIR), 4)
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        j = lines.join(orders.where("state = 'sale'").select("db", F.col("id").alias("order_id")), ["db", "order_id"])
        plan = spark._jvm.PythonSQLUtils.explainString(j._jdf.queryExecution(), "formatted")
        assert "SortMergeJoin" in plan and "Exchange" not in plan and "Bucketed: true" in plan
        again = bucketed_table(spark, f"again_{id(j)}", orders.inputFiles()[0].rsplit("/", 1)[0], ["db", "id"], 4)
        assert again.count() == orders.count()
        k = lines.join(again.select("db", F.col("id").alias("order_id")), ["db", "order_id"])
        assert "Exchange" not in spark._jvm.PythonSQLUtils.explainString(k._jdf.queryExecution(), "formatted")
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
