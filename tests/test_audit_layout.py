"""The audit table's layout: what an append and a search read of it."""

from __future__ import annotations

import datetime as dt
import glob
import uuid

import pytest
from pyspark.sql import functions as F

from ledgerflow.session import work_dir
from ledgerflow.sources.audit import AUDIT_COLUMNS, AUDIT_SCHEMA, append_audit, audit_by, read_audit, unseen_audit


def _rows(spark, ids, day=1, actor=lambda i: f"u{i % 5}"):
    t = None if day is None else dt.datetime(2024, 1, day)
    rows = [(f"k{i}", t, "invoice.approve", actor(i), None, "tln_db", "invoice", str(i), None, "success", None, None, "api", f"R{i}")
            for i in ids]
    return spark.createDataFrame(rows, AUDIT_SCHEMA)


def _plan(df) -> str:
    return df.sparkSession._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")


def scanned_rows(df) -> int:
    """Rows that the file scans of an executed plan handed on."""
    df.collect()
    total, todo = 0, [df._jdf.queryExecution().executedPlan()]
    while todo:
        node = todo.pop()
        name = node.nodeName()
        if name.startswith("AdaptiveSparkPlan"):
            todo.append(node.executedPlan())
            continue
        if name.startswith("Scan parquet"):
            total += node.metrics().apply("numOutputRows").value()
        if "QueryStage" in name:
            todo.append(node.plan())
        kids = node.children()
        todo += [kids.apply(i) for i in range(kids.size())]
    return total


@pytest.fixture
def path(spark):
    return work_dir(spark, "tests", "audit-" + uuid.uuid4().hex)


def test_append_prunes_to_the_days_of_the_batch(spark, path):
    append_audit(_rows(spark, range(40), 1), path)
    append_audit(_rows(spark, range(40, 80), 2), path)
    append_audit(_rows(spark, range(80, 90), None), path)
    plan = _plan(unseen_audit(_rows(spark, range(3), 2), path))
    filters = [x for x in plan.splitlines() if x.startswith("PartitionFilters")]
    assert any("dynamicpruning" in x and "created_date" in x for x in filters), filters
    assert any("isnull(created_date" in x for x in filters), filters


def test_append_never_opens_the_files_of_other_days(spark, path):
    """A day whose files are not Parquet at all does no harm to an append of another day."""
    append_audit(_rows(spark, range(10), 1), path)
    append_audit(_rows(spark, range(10, 20), 2), path)
    for f in glob.glob(f"{path}/created_date=2024-01-01/part-*.parquet"):
        with open(f, "wb") as out:
            out.write(b"not a table")
    append_audit(_rows(spark, range(15, 25), 2), path)
    day = read_audit(spark, path).where("created_date = date'2024-01-02'")
    assert sorted(r.id for r in day.select("id").collect()) == [f"k{i}" for i in range(10, 25)]


def test_replays_late_rows_and_rows_without_a_time_are_stored_once(spark, path):
    first = _rows(spark, range(10), 1).unionByName(_rows(spark, range(20, 25), None))
    append_audit(first, path)
    append_audit(first.unionByName(first), path)
    append_audit(_rows(spark, range(30, 33), 9), path)
    append_audit(_rows(spark, range(5, 15), 1), path)  # a late batch: half of it is there
    append_audit(_rows(spark, range(22, 27), None), path)
    append_audit(first.limit(0), path)
    got = sorted(r.id for r in read_audit(spark, path).collect())
    assert got == sorted([f"k{i}" for i in (*range(15), *range(20, 27), *range(30, 33))])


def test_search_by_actor_skips_row_groups(spark, path):
    """Actors lie scattered over all files' ranges: statistics alone would read every file."""
    rows = _rows(spark, range(4_000), 1, actor=lambda i: f"u{(i * 7919) % 1000:04d}").withColumn(
        "action_type", F.concat(F.lit("t"), (F.col("object_id").cast("int") % 8).cast("string")))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # several files although there are few rows
    try:
        append_audit(rows, path)
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    table = read_audit(spark, path)
    found = audit_by(table, actor="u0007")
    want = sorted(r.id for r in rows.where("actor = 'u0007'").collect())
    assert sorted(r.id for r in found.collect()) == want and want

    def plain(**wanted):  # without the final order, whose sampling reads the files once more
        assert all(f"{k}#" in _plan(audit_by(table, **wanted)) for k in wanted)
        return table.where(" and ".join(f"{k} = '{v}'" for k, v in wanted.items()))

    for wanted in ({"actor": "u0007"}, {"request_id": "R123"}, {"object_id": "77"}):
        assert 0 < scanned_rows(plain(**wanted)) <= table.count() / 2, wanted
    assert scanned_rows(plain(actor="u0007x")) == 0
    one = audit_by(table, object_type="invoice", object_id="77").select(*AUDIT_COLUMNS).collect()
    assert [r.id for r in one] == ["k77"]
    with pytest.raises(ValueError):
        audit_by(table)
