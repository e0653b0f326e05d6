"""Chat command routing: inputs with the rows that are expected of them."""

from __future__ import annotations

import pytest

from ledgerflow.operators.chat import parse_commands, user_facts

FIELDS = ("handler", "object_id", "db", "period", "action", "arg", "lead_limit", "doctype", "query", "error")

CASES = [
    ("/erp", "", {"handler": "erp_help"}),
    ("//ERP/", " HELP ", {"handler": "erp_help"}),
    ("/erp", "invoice", {"handler": "error", "error": "Usage: /erp invoice <id> [db]"}),
    ("/erp", "Invoice 12", {"handler": "erp_invoice", "object_id": "12", "db": "tln_db"}),
    ("/erp", "invoice\u00a0123\u2003ieg_db", {"handler": "erp_invoice", "object_id": "123", "db": "ieg_db"}),
    ("/erp", "\u3000pending\x1fieg_db\x85", {"handler": "erp_pending", "db": "ieg_db"}),
    ("/erp", "pending", {"handler": "erp_pending", "db": "tln_db"}),
    ("/erp", "sales", {"handler": "erp_sales", "period": "today", "db": "tln_db"}),
    ("/erp", "sales\tmtd ieg_db x", {"handler": "erp_sales", "period": "mtd", "db": "ieg_db"}),
    ("/erp", "stock", {"handler": "error", "error": "Unknown ERP subcommand: stock"}),
    ("/hr", "leave", {"handler": "hr_leave", "action": "status"}),
    ("/hr", "leave pending", {"handler": "hr_leave", "action": "pending"}),
    ("/hr", "leave now", {"handler": "error", "action": "now", "error": "Unknown leave action: now"}),
    ("/hr", "pending", {"handler": "hr_pending"}),
    ("/hr", "PAY", {"handler": "error", "error": "Unknown HR subcommand: pay"}),
    ("/frappe", "crm", {"handler": "frappe_crm", "action": "leads", "lead_limit": 5}),
    ("/frappe", "crm leads 12", {"handler": "frappe_crm", "action": "leads", "arg": "12", "lead_limit": 12}),
    ("/frappe", "crm leads x", {"handler": "frappe_crm", "action": "leads", "arg": "x", "lead_limit": 5}),
    ("/frappe", "crm customer", {"handler": "error", "action": "customer", "error": "Usage: /frappe crm customer <name>"}),
    ("/frappe", "crm customer Acme", {"handler": "frappe_crm", "action": "customer", "arg": "Acme"}),
    ("/frappe", "crm deals", {"handler": "error", "action": "deals", "error": "Unknown CRM action: deals"}),
    ("/frappe", "order", {"handler": "error", "error": "Usage: /frappe order <order_id>"}),
    ("/frappe", "order SO-1", {"handler": "frappe_order", "object_id": "SO-1"}),
    ("/frappe", "doc Lead", {"handler": "error", "error": "Usage: /frappe doc <doctype> <name>"}),
    ("/frappe", "doc Lead L-1", {"handler": "frappe_doc", "doctype": "Lead", "object_id": "L-1"}),
    ("/frappe", "x", {"handler": "error", "error": "Unknown Frappe subcommand: x"}),
    ("/metabase", "dashboard", {"handler": "error", "error": "Usage: /metabase dashboard <name|id>"}),
    ("/metabase", "dashboard monthly  sales", {"handler": "metabase_dashboard", "query": "monthly sales"}),
    ("/metabase", "question", {"handler": "error", "error": "Usage: /metabase question <id>"}),
    ("/metabase", "question 7", {"handler": "metabase_question", "object_id": "7"}),
    ("/metabase", "search", {"handler": "metabase_search", "query": ""}),
    ("/metabase", "search a b", {"handler": "metabase_search", "query": "a b"}),
    ("/metabase", "card", {"handler": "error", "error": "Unknown Metabase subcommand: card"}),
    ("/access", "request", {"handler": "error", "error": "Usage: /access request <app>"}),
    ("/access", "request erp", {"handler": "access_request", "query": "erp"}),
    ("/access", "status", {"handler": "access_status"}),
    ("/access", "drop", {"handler": "error", "error": "Unknown access subcommand: drop"}),
    ("/nope", "x", {"handler": "error", "error": "Unknown command: /nope"}),
    (None, "x", {"handler": "error", "error": "Unknown command: /"}),
    ("/erp", None, {"handler": "erp_help"}),
]


@pytest.fixture(scope="module")
def routed(spark):
    data = [(i, c, t) for i, (c, t, _) in enumerate(CASES)]
    rows = parse_commands(spark.createDataFrame(data, "i int, command string, text string")).collect()
    return {r.i: r for r in rows}


@pytest.mark.parametrize("i", range(len(CASES)))
def test_route(routed, i):
    assert {f: getattr(routed[i], f) for f in FIELDS} == {**dict.fromkeys(FIELDS), **CASES[i][2]}


def test_user_facts_of_missing_groups(spark):
    rows = [(1, "a@x", None, "al"), (2, "b@x", ["ak-role-boss", None, "ak-bu-ieg", "ak-role-x"], None), (3, None, [], None)]
    df = spark.createDataFrame(rows, "user_id int, email string, groups array<string>, preferred_username string")
    got = [(r.business_unit, r.roles, r.actor_role, r.username, r.actor)
           for r in user_facts(df).orderBy("user_id").collect()]
    assert got == [("", [], "service", "al", "a@x"), ("ieg", ["boss", "x"], "boss", "b@x", "b@x"), ("", [], "service", "", "")]
