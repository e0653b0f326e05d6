"""Chat command routing branches, user facts, and the streaming entry points (replay safety)."""

from __future__ import annotations

import datetime as dt
import uuid
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from ledgerflow.session import work_dir
from ledgerflow import streaming as st
from ledgerflow.operators import approvals as ap
from ledgerflow.operators.chat import parse_commands, user_facts

CASES = [
    ("/erp", "", "erp_help", {}),
    ("/ERP/", "  Help me", "erp_help", {}),
    ("/erp", "invoice", "error", {"error": "Usage: /erp invoice <id> [db]"}),
    ("/erp", "INVOICE 42", "erp_invoice", {"object_id": "42", "db": "tln_db"}),
    ("/erp", "invoice 42 ieg_db", "erp_invoice", {"object_id": "42", "db": "ieg_db"}),
    ("/erp", "pending tmi_db", "erp_pending", {"db": "tmi_db"}),
    ("/erp", "sales", "erp_sales", {"period": "today", "db": "tln_db"}),
    ("/erp", "sales MTD ieg_db", "erp_sales", {"period": "MTD", "db": "ieg_db"}),
    ("/erp", "foo", "error", {"error": "Unknown ERP subcommand: foo"}),
    ("/hr", "leave", "hr_leave", {"action": "status"}),
    ("/hr", "leave pending", "hr_leave", {"action": "pending"}),
    ("/hr", "leave Status", "error", {"error": "Unknown leave action: Status"}),
    ("/hr", "pending", "hr_pending", {}),
    ("/frappe", "crm", "frappe_crm", {"action": "leads", "lead_limit": 5}),
    ("/frappe", "crm leads 12", "frappe_crm", {"action": "leads", "lead_limit": 12}),
    ("/frappe", "crm leads x1", "frappe_crm", {"action": "leads", "lead_limit": 5, "arg": "x1"}),
    ("/frappe", "crm customer", "error", {"error": "Usage: /frappe crm customer <name>"}),
    ("/frappe", "crm customer CUST-1", "frappe_crm", {"action": "customer", "arg": "CUST-1"}),
    ("/frappe", "crm deals", "error", {"error": "Unknown CRM action: deals"}),
    ("/frappe", "order SAL-ORD-1", "frappe_order", {"object_id": "SAL-ORD-1"}),
    ("/frappe", "doc Customer", "error", {"error": "Usage: /frappe doc <doctype> <name>"}),
    ("/frappe", "doc Customer CUST-1", "frappe_doc", {"doctype": "Customer", "object_id": "CUST-1"}),
    ("/metabase", "dashboard   monthly \t sales", "metabase_dashboard", {"query": "monthly sales"}),
    ("/metabase", "question", "error", {"error": "Usage: /metabase question <id>"}),
    ("/metabase", "search", "metabase_search", {"query": ""}),
    ("/access", "request erp", "access_request", {"query": "erp"}),
    ("/access", "status", "access_status", {}),
    ("/access", "revoke", "error", {"error": "Unknown access subcommand: revoke"}),
    ("/nope", "anything", "error", {"error": "Unknown command: /nope"}),
]


def test_command_routing(spark):
    rows = [(i, c, t) for i, (c, t, _, _) in enumerate(CASES)]
    out = {r.i: r for r in parse_commands(spark.createDataFrame(rows, "i int, command string, text string")).collect()}
    for i, (_, _, handler, fields) in enumerate(CASES):
        r = out[i]
        assert r.handler == handler, (CASES[i], r)
        for k, v in fields.items():
            assert getattr(r, k) == v, (CASES[i], k, getattr(r, k))
        if handler != "error":
            assert r.error is None, CASES[i]


def test_user_facts(spark):
    df = spark.createDataFrame([(["ak-bu-tln", "ak-role-manager", "ak-role-analyst"],),
                                (["ak-dept-ops", "ak-bu-ieg", "ak-bu-tmi"],), ([],), (["ak-bu-ak-bu-x"],)],
                               "groups array<string>")
    got = [(r.business_unit, r.roles, r.actor_role) for r in user_facts(df).collect()]
    assert got == [("tln", ["manager", "analyst"], "manager"), ("ieg", [], "service"), ("", [], "service"),
                   ("x", [], "service")]


REQ_SCHEMA = ("request_id string, object_type string, db string, object_id bigint, action string, actor string, "
              "actor_role string, reason string, source string, requested_at timestamp_ntz")


def _invoices(spark):
    moves = spark.createDataFrame(
        [(1, "tln_db", "INV/1", "draft", "out_invoice", Decimal("1.00"), Decimal("1.00"), 1, 1, None, None, None, None),
         (2, "tln_db", "INV/2", "draft", "out_invoice", Decimal("2.00"), Decimal("2.00"), 1, 1, None, None, None, None)],
        "id bigint, db string, name string, state string, move_type string, amount_total decimal(18,2), "
        "amount_residual decimal(18,2), partner_id bigint, currency_id int, date date, invoice_date date, "
        "invoice_date_due date, create_date timestamp_ntz")
    return moves


def _partners(spark):
    return spark.createDataFrame([(1, "P")], "id bigint, name string")


def test_approval_stream_carries_state_and_survives_restart(spark):
    t0 = dt.datetime(2024, 1, 1)
    root = work_dir(spark, "tests", "stream-" + uuid.uuid4().hex)
    feed, outc, states, ckpt = (f"{root}/{x}" for x in ("feed", "out", "states", "ckpt"))
    b1 = [("A", "invoice", "tln_db", 1, "approve", "u", None, None, "api", t0)]
    b2 = [("B", "invoice", "tln_db", 1, "approve", "u", None, None, "api", t0 + dt.timedelta(hours=1)),
          ("C", "invoice", "tln_db", 2, "reject", "u", None, None, "api", t0 + dt.timedelta(hours=1)),
          ("C", "invoice", "tln_db", 2, "reject", "u", None, None, "api", t0 + dt.timedelta(hours=1)),
          (None, "invoice", "tln_db", 2, "reject", "v", None, None, "api", t0 + dt.timedelta(hours=2)),
          (None, "invoice", "tln_db", 2, "reject", "v", None, None, "api", t0 + dt.timedelta(hours=3))]
    schema = spark.createDataFrame([], REQ_SCHEMA).schema

    def start():
        return st.approval_stream(spark.readStream.schema(schema).parquet(feed), lambda: _invoices(spark), "invoice",
                                  outc, states, ckpt, partners=lambda: _partners(spark), compact_every=1)

    spark.createDataFrame(b1, REQ_SCHEMA).write.mode("append").parquet(feed)
    st.drain(start())
    spark.createDataFrame(b2, REQ_SCHEMA).write.mode("append").parquet(feed)
    st.drain(start())
    st.drain(start())  # nothing new: no batch, no duplicate rows
    all_rows = spark.read.parquet(outc).collect()
    assert sum(r.request_id is None for r in all_rows) == 2  # id-less requests are not merged
    rows = {r.request_id: r for r in all_rows if r.request_id is not None}
    assert set(rows) == {"A", "B", "C"}
    assert rows["A"].outcome == "success"
    assert rows["B"].outcome == "already_approved" and rows["B"].state_before == "posted"
    assert rows["C"].outcome == "success"
    cur = {r.object_id: r.state for r in st.current_states(spark, states).collect()}
    assert cur == {"1": "posted", "2": "cancel"}
    assert st._exists(spark, f"{states}_compact/batch_id=1/_SUCCESS")  # compacted after batch 1
    # replaying batch 1 by hand changes nothing (idempotent by batch id)
    st.approval_batch(spark, spark.createDataFrame(b1, REQ_SCHEMA), 0, lambda: _invoices(spark), "invoice",
                      outc, states, lambda: _partners(spark))
    assert spark.read.parquet(outc).count() == 5


def test_command_stream_equals_batch(spark):
    root = work_dir(spark, "tests", "cmd-" + uuid.uuid4().hex)
    rows = [(i, c, t) for i, (c, t, _, _) in enumerate(CASES)]
    df = spark.createDataFrame(rows, "i int, command string, text string")
    df.write.parquet(f"{root}/feed")
    st.drain(st.command_stream(spark.readStream.schema(df.schema).parquet(f"{root}/feed"), f"{root}/out",
                               f"{root}/ckpt"))
    got = spark.read.parquet(f"{root}/out")
    want = parse_commands(df)
    assert got.exceptAll(want.select(*got.columns)).count() == 0 and got.count() == len(CASES)


def test_audit_append_dedupes_replays(spark):
    from ledgerflow.sources.audit import append_audit, read_audit

    t0 = dt.datetime(2024, 1, 1)
    reqs = spark.createDataFrame([("A", "invoice", "tln_db", 1, "approve", "u", None, None, None, t0)], REQ_SCHEMA)
    rows = ap.audit_rows(ap.apply_approvals(reqs, _invoices(spark), "invoice", _partners(spark)))
    path = work_dir(spark, "tests", "audit-" + uuid.uuid4().hex) + "/audit"
    append_audit(rows, path)
    append_audit(rows, path)
    got = read_audit(spark, path)
    assert got.count() == 1 and got.first().created_date == dt.date(2024, 1, 1)
    with pytest.raises(Exception):
        spark.read.parquet(path + "/missing").count()


def test_recent_audit_prunes_days_and_stays_exact(spark):
    from ledgerflow.operators.lists import recent_audit
    from ledgerflow.sources.audit import append_audit, conform_audit, read_audit

    rows = spark.createDataFrame(
        [(f"k{i}", dt.datetime(2024, 1, 1 + i // 10, i % 24), "invoice.approve" if i % 2 else "leave.reject",
          f"u{i % 3}", None, "tln_db", "invoice", str(i), None, "success", None, None, "api", f"R{i}")
         for i in range(100)],
        "id string, created_at timestamp_ntz, action_type string, actor string, actor_role string, odoo_db string, "
        "object_type string, object_id string, object_data string, result string, error_message string, "
        "metadata string, source string, request_id string")
    path = work_dir(spark, "tests", "recent-" + uuid.uuid4().hex)
    append_audit(rows, path, dedupe=False)
    table = read_audit(spark, path)
    for kwargs in ({"limit": 15}, {"limit": 7, "action_type": "invoice.approve"}, {"limit": 500}):
        got = [r.id for r in recent_audit(table, **kwargs).collect()]
        want = [r.id for r in recent_audit(conform_audit(rows), **kwargs).collect()]
        assert got == want, kwargs
    df = recent_audit(table, limit=15)
    plan = spark._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")
    pf = [x for x in plan.splitlines() if x.startswith("PartitionFilters")]
    assert pf and "2024-01-09" in pf[0], pf  # only the newest two days are read


def test_audit_stream_equals_batch_rows(spark):
    from ledgerflow.sources.audit import AUDIT_COLUMNS

    t0 = dt.datetime(2024, 1, 1)
    reqs = spark.createDataFrame(
        [("A", "invoice", "tln_db", 1, "approve", "u", None, None, None, t0),
         ("B", "invoice", "tln_db", 2, "reject", "u", None, "dup", "api", t0 + dt.timedelta(days=1)),
         ("C", "invoice", "tln_db", 9, "approve", "u", None, None, None, t0)], REQ_SCHEMA)
    outcomes = ap.apply_approvals(reqs, _invoices(spark), "invoice", _partners(spark))
    root = work_dir(spark, "tests", "auditstream-" + uuid.uuid4().hex)
    outcomes.write.parquet(f"{root}/feed")
    st.drain(st.audit_stream(spark.readStream.schema(outcomes.schema).parquet(f"{root}/feed"), f"{root}/audit",
                             f"{root}/ckpt"))
    got = spark.read.parquet(f"{root}/audit")
    assert sorted(r.created_date.isoformat() for r in got.select("created_date").collect()) == [
        "2024-01-01", "2024-01-02"]
    want = ap.audit_rows(outcomes)
    assert got.select(*AUDIT_COLUMNS).exceptAll(want).count() == 0 and got.count() == 2


def test_requests_without_ids_keep_distinct_audit_rows(spark):
    from ledgerflow.sources.audit import append_audit, read_audit

    t0 = dt.datetime(2024, 1, 1)
    reqs = spark.createDataFrame(
        [(None, "invoice", "tln_db", 1, "reject", "u", None, None, None, t0),
         (None, "invoice", "tln_db", 1, "reject", "u", None, None, None, t0 + dt.timedelta(minutes=5))], REQ_SCHEMA)
    rows = ap.audit_rows(ap.apply_approvals(reqs, _invoices(spark), "invoice", _partners(spark)))
    path = work_dir(spark, "tests", "noid-" + uuid.uuid4().hex)
    append_audit(rows, path)
    append_audit(rows, path)  # a replay of the same two rows adds nothing
    assert read_audit(spark, path).count() == 2


def test_leave_approval_stream_equals_batch(spark):
    from ledgerflow.sources.fixtures import fixtures

    from __spark_entry__ import SMOKE_DIR

    fx = fixtures(spark, SMOKE_DIR)
    reqs, leaves = fx["approval_request_leave"], fx["hr_leave"]
    batch = {r.request_id: (r.outcome, r.state_before, r.new_state)
             for r in ap.apply_approvals(reqs, leaves, "leave").collect()}
    root = work_dir(spark, "tests", "leavestream-" + uuid.uuid4().hex)
    feed, outc, states, ckpt = (f"{root}/{x}" for x in ("feed", "out", "states", "ckpt"))
    cut = reqs.agg(F.percentile_approx("requested_at", 0.5)).first()[0]
    for part in (reqs.filter(F.col("requested_at") <= F.lit(cut)), reqs.filter(F.col("requested_at") > F.lit(cut))):
        part.write.mode("append").parquet(feed)
        st.drain(st.approval_stream(spark.readStream.schema(reqs.schema).parquet(feed), lambda: leaves, "leave",
                                    outc, states, ckpt))
    got = {r.request_id: (r.outcome, r.state_before, r.new_state) for r in spark.read.parquet(outc).collect()}
    assert got == batch and len(got) == reqs.count()
