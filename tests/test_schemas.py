"""Every operator returns exactly its declared output schema (names, order, types)."""

from __future__ import annotations

import pytest

from ledgerflow import schemas as S
from ledgerflow.operators import approvals as ap
from ledgerflow.operators import digests as dg
from ledgerflow.operators import lists as ls
from ledgerflow.operators import metrics as m
from ledgerflow.operators import worklists as wl
from ledgerflow.plans.registry import AS_OF
from ledgerflow.sources.fixtures import fixtures

from __spark_entry__ import SMOKE_DIR

CASES = {
    "SALES_SUMMARY": lambda fx: m.sales_summary(fx["sale_order"], AS_OF),
    "SALES_COMPARISON": lambda fx: m.sales_comparison(fx["sale_order"], AS_OF),
    "TOP_PRODUCT": lambda fx: m.top_products(fx["sale_order_line"], fx["sale_order"], fx["product_product"],
                                             fx["product_template"], AS_OF),
    "CUSTOMER_RISK": lambda fx: m.customer_risk(fx["account_move"], fx["res_partner"], AS_OF),
    "OVERDUE_SUMMARY": lambda fx: m.overdue_summary(fx["account_move"], AS_OF),
    "OVERDUE_INVOICE": lambda fx: ls.overdue_invoices(fx["account_move"], fx["res_partner"], fx["res_currency"],
                                                      AS_OF),
    "PENDING_INVOICE": lambda fx: ls.pending_invoices(fx["account_move"], fx["res_partner"]),
    "INVOICE_DETAIL": lambda fx: ls.invoice_detail(fx["account_move"], fx["res_partner"], fx["res_currency"]),
    "PENDING_ITEM": lambda fx: wl.pending_approvals(fx["account_move"], AS_OF),
    "INVOICE_CONTEXT": lambda fx: wl.invoice_context(fx["account_move"], fx["res_partner"], AS_OF),
    "EXPENSE_CONTEXT": lambda fx: wl.expense_context(fx["hr_expense"]),
    "LEAVE_CONTEXT": lambda fx: wl.leave_context(fx["hr_leave"]),
    "SALES_DIGEST": lambda fx: dg.sales_digest(fx["sale_order"], fx["sale_order_line"], fx["product_product"],
                                               fx["product_template"], AS_OF),
    "FINANCE_DIGEST": lambda fx: dg.finance_digest(fx["account_move"], AS_OF),
    "OPS_DIGEST": lambda fx: dg.ops_digest(fx["sale_order"], fx["stock_picking"], AS_OF),
    "APPROVAL_OUTCOME": lambda fx: ap.apply_approvals(fx["approval_request_leave"], fx["hr_leave"], "leave"),
    "OBJECT_STATE": lambda fx: ap.new_states(ap.apply_approvals(fx["approval_request_expense"], fx["hr_expense"],
                                                                "expense")),
}


@pytest.mark.parametrize("name", sorted(CASES))
def test_operator_schema(spark, name):
    df = CASES[name](fixtures(spark, SMOKE_DIR))
    assert df.schema.simpleString() == S.struct_of(spark, getattr(S, name)).simpleString()


def test_overdue_items_share_the_pending_item_schema(spark):
    df = wl.overdue_items(fixtures(spark, SMOKE_DIR)["account_move"], AS_OF)
    assert df.schema.simpleString() == S.struct_of(spark, S.PENDING_ITEM).simpleString()
