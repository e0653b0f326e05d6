"""Registered approval-batch queries (O-58..O-60, O-05) with their DuckDB oracles.

The oracles use the textbook formulation (running counts over a per-object
window, or ``lag``), independent of the aggregate-based Spark plan.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerflow.operators import approvals as ap
from ledgerflow.plans.registry import register

_REQ_COLS = ("q.request_id, q.db, q.object_type, CAST(q.object_id AS VARCHAR) AS object_id, q.action, q.actor, "
             "q.actor_role, q.reason, coalesce(q.source, 'api') AS source, q.requested_at")

_INVOICE_BASE = """
, obj AS (SELECT am.*, rp.name AS partner_name FROM account_move am LEFT JOIN res_partner rp ON am.partner_id = rp.id),
  r AS (SELECT q.*, m.state AS initial_state, m.id AS mid, m.name AS inv_name, m.amount_total AS amt,
               m.partner_name, m.move_type, m.amount_residual, m.partner_id, m.invoice_date, m.invoice_date_due,
               m.currency_id,
               coalesce(sum(CASE WHEN q.action = 'reject' THEN 1 ELSE 0 END) OVER w, 0) AS prior_rejects,
               coalesce(sum(CASE WHEN q.action = 'approve' THEN 1 ELSE 0 END) OVER w, 0) AS prior_approves
        FROM approval_request q LEFT JOIN obj m ON q.object_id = m.id AND q.db = m.db
        WHERE q.action IN ('approve', 'reject')
        WINDOW w AS (PARTITION BY q.db, q.object_id ORDER BY q.requested_at, q.request_id
                     ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
  s AS (SELECT *, CASE WHEN mid IS NULL THEN NULL
                       WHEN prior_rejects > 0 THEN 'cancel'
                       WHEN prior_approves > 0 AND initial_state = 'draft' THEN 'posted'
                       ELSE initial_state END AS state_before FROM r),
  o AS (SELECT *, CASE WHEN mid IS NULL THEN 'not_found' WHEN action = 'reject' THEN 'success'
                       WHEN state_before = 'posted' THEN 'already_approved'
                       WHEN state_before <> 'draft' THEN 'invalid_state' ELSE 'success' END AS outcome FROM s),
  res AS (SELECT """ + _REQ_COLS + """, q.outcome, q.outcome = 'success' AS success, q.state_before,
               CASE WHEN q.outcome = 'success' THEN (CASE WHEN q.action = 'approve' THEN 'posted' ELSE 'cancel' END)
                    END AS new_state,
               CASE WHEN q.outcome = 'success' THEN 'Invoice ' || q.inv_name || ' '
                    || (CASE WHEN q.action = 'approve' THEN 'approved' ELSE 'rejected' END)
                    || ' (' || coalesce(q.partner_name, 'Unknown') || ', Rp ' || format('{:,.0f}', CAST(q.amt AS DOUBLE))
                    || ')' END AS summary,
               CASE WHEN q.mid IS NOT NULL THEN CAST(to_json(struct_pack(id := q.mid, name := q.inv_name,
                    state := q.state_before, move_type := q.move_type, amount_total := q.amt,
                    amount_residual := q.amount_residual, partner_id := q.partner_id, partner_name := q.partner_name,
                    invoice_date := CAST(q.invoice_date AS VARCHAR), invoice_date_due := CAST(q.invoice_date_due AS VARCHAR),
                    currency_id := q.currency_id)) AS VARCHAR) END AS object_data
          FROM o q
          UNION ALL
          SELECT """ + _REQ_COLS + """, 'invalid_request', false, CAST(NULL AS VARCHAR), CAST(NULL AS VARCHAR),
                 CAST(NULL AS VARCHAR), CAST(NULL AS VARCHAR)
          FROM approval_request q WHERE q.action IS NULL OR q.action NOT IN ('approve', 'reject'))"""

_INVOICE_VIEWS = ["approval_request", "account_move", "res_partner"]


def _invoice_outcomes(fx):
    return ap.apply_approvals(fx["approval_request"], fx["account_move"], "invoice", fx["res_partner"])


@register("invoice_approvals", _INVOICE_VIEWS, _INVOICE_BASE + "\nSELECT * FROM res")
def invoice_approvals(fx):
    """O-58: every invoice approval request of the batch, folded in request order per invoice."""
    return _invoice_outcomes(fx)


_AUDIT_ID = """sha256(concat_ws('|', sha256(CAST(to_json([db, object_type, CAST(object_id AS VARCHAR), action, actor,
                strftime(requested_at, '%Y-%m-%d %H:%M:%S.%f'), request_id]) AS VARCHAR)), '{result}'))"""
_AUDIT_SELECT = """
SELECT """ + _AUDIT_ID.format(result="success") + """ AS id,
       requested_at AS created_at, object_type || '.' || action AS action_type, actor, actor_role,
       db AS odoo_db, object_type, object_id, object_data, 'success' AS result, CAST(NULL AS VARCHAR) AS error_message,
       {meta} AS metadata, source, request_id
FROM res WHERE success
"""


@register("invoice_audit_rows", _INVOICE_VIEWS, _INVOICE_BASE + _AUDIT_SELECT.format(
    meta="CASE WHEN reason IS NOT NULL AND reason <> '' THEN CAST(to_json(struct_pack(reason := reason)) AS VARCHAR) END"))
def invoice_audit_rows(fx):
    """O-05: audit rows of the successful invoice requests (object as it was before, reason as metadata)."""
    return ap.audit_rows(_invoice_outcomes(fx))


@register("invoice_new_states", _INVOICE_VIEWS, _INVOICE_BASE + """
, last AS (SELECT db, object_type, object_id, new_state, requested_at,
                  row_number() OVER (PARTITION BY db, object_type, object_id
                                     ORDER BY requested_at DESC, request_id DESC) AS rn,
                  max(requested_at) OVER (PARTITION BY db, object_type, object_id) AS changed_at
           FROM res WHERE success AND new_state IS NOT NULL)
SELECT db, object_type, object_id, new_state AS state, changed_at FROM last WHERE rn = 1
""")
def invoice_new_states(fx):
    """O-58: state of each touched invoice after the batch."""
    return ap.new_states(_invoice_outcomes(fx))


@register("invoice_rejection_notes", _INVOICE_VIEWS, _INVOICE_BASE + """
SELECT db, 'account.move' AS model, CAST(object_id AS BIGINT) AS res_id, '<p>Rejected: ' || reason || '</p>' AS body,
       'comment' AS message_type, request_id, requested_at AS created_at
FROM res WHERE success AND object_type = 'invoice' AND action = 'reject' AND reason IS NOT NULL AND reason <> ''
""")
def invoice_rejection_notes(fx):
    """O-58 data effect: the note written on each invoice rejected with a reason."""
    return ap.rejection_notes(_invoice_outcomes(fx))


_EXPENSE_BASE = """
, r AS (SELECT q.*, m.state AS initial_state, m.id AS mid, m.name AS e_name, m.total_amount, m.employee_id,
               m.employee_name, m.date AS e_date, m.description,
               coalesce(sum(CASE WHEN q.action = 'approve' THEN 1 ELSE 0 END) OVER w, 0) AS prior_approves
        FROM approval_request_expense q LEFT JOIN hr_expense m ON q.object_id = m.id AND q.db = m.db
        WHERE q.action IN ('approve', 'reject')
        WINDOW w AS (PARTITION BY q.db, q.object_id ORDER BY q.requested_at, q.request_id
                     ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
  s AS (SELECT *, CASE WHEN mid IS NULL THEN NULL WHEN prior_approves > 0 THEN 'approved'
                       ELSE initial_state END AS state_before,
               CASE WHEN mid IS NULL THEN 'not_found' ELSE 'success' END AS outcome FROM r),
  res AS (SELECT """ + _REQ_COLS + """, q.outcome, q.outcome = 'success' AS success, q.state_before,
               CASE WHEN q.outcome = 'success' THEN (CASE WHEN q.action = 'approve' THEN 'approved' ELSE 'refused' END)
                    END AS new_state,
               CASE WHEN q.outcome = 'success' THEN 'Expense ' || q.e_name || ' '
                    || (CASE WHEN q.action = 'approve' THEN 'approved' ELSE 'rejected' END)
                    || ' (Rp ' || format('{:,.0f}', CAST(q.total_amount AS DOUBLE)) || ')' END AS summary,
               CASE WHEN q.mid IS NOT NULL THEN CAST(to_json(struct_pack(id := q.mid, name := q.e_name,
                    state := q.state_before, total_amount := q.total_amount, employee_id := q.employee_id,
                    employee_name := q.employee_name, date := CAST(q.e_date AS VARCHAR),
                    description := q.description)) AS VARCHAR) END AS object_data
          FROM s q
          UNION ALL
          SELECT """ + _REQ_COLS + """, 'invalid_request', false, CAST(NULL AS VARCHAR), CAST(NULL AS VARCHAR),
                 CAST(NULL AS VARCHAR), CAST(NULL AS VARCHAR)
          FROM approval_request_expense q WHERE q.action IS NULL OR q.action NOT IN ('approve', 'reject'))"""

_EXPENSE_VIEWS = ["approval_request_expense", "hr_expense"]


def _expense_outcomes(fx):
    return ap.apply_approvals(fx["approval_request_expense"], fx["hr_expense"], "expense")


@register("expense_approvals", _EXPENSE_VIEWS, _EXPENSE_BASE + "\nSELECT * FROM res")
def expense_approvals(fx):
    """O-59: every expense approval request of the batch (no state check; reject leaves the object)."""
    return _expense_outcomes(fx)


@register("expense_audit_rows", _EXPENSE_VIEWS, _EXPENSE_BASE + _AUDIT_SELECT.format(meta="CAST(NULL AS VARCHAR)"))
def expense_audit_rows(fx):
    """O-05 for expenses."""
    return ap.audit_rows(_expense_outcomes(fx))


_LEAVE_BASE = """
, r AS (SELECT q.*, m.state AS initial_state, m.id AS mid, m.display_name AS l_name, m.employee_id, m.employee_name,
               m.date_from, m.date_to, m.number_of_days, m.holiday_status_name,
               lag(q.action) OVER (PARTITION BY q.db, q.object_id ORDER BY q.requested_at, q.request_id) AS prev_action
        FROM approval_request_leave q LEFT JOIN hr_leave m ON q.object_id = m.id AND q.db = m.db
        WHERE q.action IN ('approve', 'reject')),
  s AS (SELECT *, CASE WHEN mid IS NULL THEN NULL WHEN prev_action = 'approve' THEN 'approved'
                       WHEN prev_action = 'reject' THEN 'rejected' ELSE initial_state END AS state_before,
               CASE WHEN mid IS NULL THEN 'not_found' ELSE 'success' END AS outcome FROM r),
  res AS (SELECT """ + _REQ_COLS + """, q.outcome, q.outcome = 'success' AS success, q.state_before,
               CASE WHEN q.outcome = 'success' THEN (CASE WHEN q.action = 'approve' THEN 'approved' ELSE 'rejected' END)
                    END AS new_state,
               CASE WHEN q.outcome = 'success' THEN 'Leave ' || q.l_name || ' '
                    || (CASE WHEN q.action = 'approve' THEN 'approved' ELSE 'rejected' END)
                    || ' (' || CAST(q.number_of_days AS VARCHAR) || ' days)' END AS summary,
               CASE WHEN q.mid IS NOT NULL THEN CAST(to_json(struct_pack(id := q.mid, display_name := q.l_name,
                    state := q.state_before, employee_id := q.employee_id, employee_name := q.employee_name,
                    date_from := CAST(q.date_from AS VARCHAR), date_to := CAST(q.date_to AS VARCHAR),
                    number_of_days := q.number_of_days, holiday_status_name := q.holiday_status_name)) AS VARCHAR) END AS object_data
          FROM s q
          UNION ALL
          SELECT """ + _REQ_COLS + """, 'invalid_request', false, CAST(NULL AS VARCHAR), CAST(NULL AS VARCHAR),
                 CAST(NULL AS VARCHAR), CAST(NULL AS VARCHAR)
          FROM approval_request_leave q WHERE q.action IS NULL OR q.action NOT IN ('approve', 'reject'))"""

_LEAVE_VIEWS = ["approval_request_leave", "hr_leave"]


def _leave_outcomes(fx):
    return ap.apply_approvals(fx["approval_request_leave"], fx["hr_leave"], "leave")


@register("leave_approvals", _LEAVE_VIEWS, _LEAVE_BASE + "\nSELECT * FROM res")
def leave_approvals(fx):
    """O-60: every leave approval request of the batch (the last action before a request sets its state)."""
    return _leave_outcomes(fx)


@register("leave_audit_rows", _LEAVE_VIEWS, _LEAVE_BASE + _AUDIT_SELECT.format(meta="CAST(NULL AS VARCHAR)"))
def leave_audit_rows(fx):
    """O-05 for leave requests."""
    return ap.audit_rows(_leave_outcomes(fx))


# Repeats of one request, one id on two objects, equal numbers in two companies, requests without a time.
_REPLAYS = (_INVOICE_BASE.replace("FROM approval_request q", "FROM (SELECT DISTINCT * FROM approval_request_replays) q")
            .replace("ORDER BY q.requested_at, q.request_id", "ORDER BY q.requested_at NULLS FIRST, q.request_id"))
_REPLAY_VIEWS = ["approval_request_replays", "account_move", "res_partner"]


@register("approvals_with_replays", _REPLAY_VIEWS, _REPLAYS + "\nSELECT * FROM res")
def approvals_with_replays(fx):
    """O-58: a batch that repeats requests; each has one outcome."""
    return ap.apply_approvals(fx["approval_request_replays"], fx["account_move"], "invoice", fx["res_partner"])


@register("approval_messages", _INVOICE_VIEWS, _INVOICE_BASE + """
SELECT *, CASE WHEN success THEN 'success' ELSE 'failed' END AS result,
       CASE outcome WHEN 'not_found' THEN 'Invoice ' || object_id || ' not found'
                    WHEN 'already_approved' THEN 'Invoice ' || object_id || ' is already approved'
                    WHEN 'invalid_state' THEN 'Invoice ' || object_id || ' cannot be approved in state ' || state_before
       END AS error_message
FROM res""")
def approval_messages(fx):
    """O-58: result and refusal message of each request."""
    return ap.approval_messages(_invoice_outcomes(fx))


@register("failed_audit_rows", ["approval_request"], """
SELECT """ + _AUDIT_ID.format(result="failed") + """ AS id,
       requested_at AS created_at, object_type || '.' || action AS action_type, actor, actor_role, db AS odoo_db,
       object_type, CAST(object_id AS VARCHAR) AS object_id, CAST(NULL AS VARCHAR) AS object_data, 'failed' AS result,
       'remote error ' || action AS error_message, CAST(NULL AS VARCHAR) AS metadata, source, request_id
FROM approval_request WHERE reason IS NOT NULL""")
def failed_audit_rows(fx):
    """O-05: audit rows of requests that the ERP answered with an error."""
    error = F.when(F.col("reason").isNotNull(), F.concat(F.lit("remote error "), "action"))
    return ap.failed_audit_rows(fx["approval_request"].withColumn("error_message", error), "invoice")
