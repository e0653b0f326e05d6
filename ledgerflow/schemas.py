"""Output schemas of the operators (fixed, as the service's response models are).

Written as DDL so they read like the response models; ``struct_of`` turns one
into a ``StructType``. ``tests/test_schemas.py`` checks that each operator
returns exactly its schema (names, order and types).
"""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import types as T

ALERT = "struct<type:string,message:string>"
CONTEXT_COMMON = ("db string, object_type string, object_id string, display_name string, state string, "
                  "amount double, partner string, due_date date, days_overdue int, "
                  "available_actions array<string>, requires_role string")

SALES_SUMMARY = ("db string, period string, total_revenue double, order_count bigint, avg_order_value double, "
                 "currency string, comparison_previous string")
SALES_COMPARISON = "db string, current_revenue double, previous_revenue double, comparison string"
TOP_PRODUCT = ("db string, rank int, product_id bigint, product_code string, product_name string, quantity double, "
               "revenue double")
CUSTOMER_RISK = ("db string, customer_id bigint, customer_name string, total_receivable double, total_overdue double, "
                 "overdue_count bigint, avg_days_to_pay double, last_payment_date date, risk_score string")
OVERDUE_SUMMARY = ("db string, overdue_count bigint, total_overdue_amount double, severe_overdue_count bigint, "
                   "severe_overdue_amount double")
OVERDUE_INVOICE = ("db string, rank int, id bigint, name string, state string, partner_name string, "
                   "amount_total double, amount_residual double, date_due date, days_overdue int, currency string")
PENDING_INVOICE = ("db string, rank int, id bigint, name string, state string, amount_total double, "
                   "create_date timestamp_ntz, partner_name string")
INVOICE_DETAIL = ("db string, id bigint, name string, state string, move_type string, amount_total double, "
                  "amount_residual double, currency_id int, date date, invoice_date date, invoice_date_due date, "
                  "partner_name string, partner_id bigint, currency_symbol string")
PENDING_ITEM = ("db string, rank int, object_type string, object_id string, display_name string, amount double, "
                "waiting_since timestamp_ntz, days_pending int, priority string, assignee string")
INVOICE_CONTEXT = CONTEXT_COMMON + ", additional_info struct<amount_residual:double,move_type:string>"
EXPENSE_CONTEXT = CONTEXT_COMMON + ", additional_info struct<description:string>"
LEAVE_CONTEXT = (CONTEXT_COMMON + ", additional_info struct<leave_type:string,number_of_days:double,"
                 "date_from:string,date_to:string>")
SALES_DIGEST = ("db string, digest_type string, period string, total_revenue double, order_count bigint, "
                "avg_order_value double, top_products array<struct<product_code:string,product_name:string,"
                f"quantity:double,revenue:double>>, comparison_yesterday string, pending_orders bigint, "
                f"alerts array<{ALERT}>")
FINANCE_DIGEST = ("db string, digest_type string, period string, total_receivable double, total_payable double, "
                  "overdue_receivable double, overdue_count bigint, severe_overdue_count bigint, "
                  f"alerts array<{ALERT}>")
OPS_DIGEST = ("db string, digest_type string, period string, pending_orders bigint, pending_deliveries bigint, "
              f"low_stock_items bigint, alerts array<{ALERT}>")
APPROVAL_OUTCOME = ("request_id string, db string, object_type string, object_id string, action string, "
                    "actor string, actor_role string, reason string, source string, requested_at timestamp_ntz, "
                    "outcome string, success boolean, state_before string, new_state string, summary string, "
                    "object_data string")
OBJECT_STATE = "db string, object_type string, object_id string, state string, changed_at timestamp_ntz"
PARSED_COMMAND_FIELDS = ("subcommand string, handler string, object_id string, db string, period string, "
                         "action string, arg string, lead_limit bigint, doctype string, query string, error string")


def struct_of(spark: SparkSession, ddl: str) -> T.StructType:
    """The ``StructType`` of a DDL column list (parsed by Spark)."""
    return spark.createDataFrame([], ddl).schema
