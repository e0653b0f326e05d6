"""Batches of approval requests: outcome, state before, new state, summary and audit rows (O-58..O-60, O-05).

Requests for one object form a fold: each sees the state the earlier ones left.
The fold needs no loop and no per-object window:

* invoices: ``cancel`` and ``posted`` are never left for ``draft``, so the state
  before a request is fixed by whether *some* reject / approve came earlier.
  That is a comparison with the object's first reject and first approve, two
  ``min`` aggregates per object (partial aggregation; a hot object costs one
  row per task);
* expenses: a reject leaves the object as it is, so only "an approve came
  earlier" matters (same aggregate);
* leaves: the last action wins, so the state before is set by the previous
  request's action, taken with the skew-safe distributed lag in ``sequence``.

Requests are then joined once with the per-object table (one row per object).
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerflow import functions as lf
from ledgerflow.constants import (
    ACTION_PAST, APPROVAL_ACTIONS, DEFAULT_SOURCE, DEFAULT_TRANSITIONS, DRAFT, POSTED, SUMMARY_EXPENSE, SUMMARY_INVOICE, SUMMARY_LEAVE,
    MESSAGE_ALREADY_APPROVED, MESSAGE_INVALID_STATE, MESSAGE_NOT_FOUND, UNCHANGED_BY, UNKNOWN_PARTNER,
)
from ledgerflow.operators.sequence import with_previous
from ledgerflow.operators.topk import company_keys, lookup

REQUEST_COLUMNS = ("request_id", "object_type", "db", "object_id", "action", "actor", "actor_role", "reason",
                   "source", "requested_at")


# --- objects as the approval flow sees them ----------------------------------------------------
# Each takes the rows of the object table that requests name (already restricted) and
# shapes them: state, the fields the summary needs, and the snapshot stored in the audit row.

def invoice_objects(moves: DataFrame, partners: DataFrame | None = None) -> DataFrame:
    m = moves
    if partners is not None:
        m = lookup(m, partners, company_keys("partner_id", partners), {"name": "partner_name"}, None)
    elif "partner_name" not in m.columns:
        m = m.withColumn("partner_name", F.lit(None).cast("string"))
    return m.select(
        "db", F.col("id").alias("object_id"), "state",
        F.col("name").alias("_name"), F.col("amount_total").alias("_amount"), F.col("partner_name").alias("_partner"),
        F.struct(
            F.col("id"), F.col("name"), F.col("state"), F.col("move_type"),
            F.col("amount_total"), F.col("amount_residual"), F.col("partner_id"), F.col("partner_name"),
            F.col("invoice_date").cast("string").alias("invoice_date"),
            F.col("invoice_date_due").cast("string").alias("invoice_date_due"),
            F.col("currency_id"),
        ).alias("_snapshot"),
    )


def expense_objects(expenses: DataFrame, partners: DataFrame | None = None) -> DataFrame:
    return expenses.select(
        "db", F.col("id").alias("object_id"), "state",
        F.col("name").alias("_name"), F.col("total_amount").alias("_amount"),
        F.struct(
            F.col("id"), F.col("name"), F.col("state"), F.col("total_amount"), F.col("employee_id"),
            F.col("employee_name"), F.col("date").cast("string").alias("date"), F.col("description"),
        ).alias("_snapshot"),
    )


def leave_objects(leaves: DataFrame, partners: DataFrame | None = None) -> DataFrame:
    return leaves.select(
        "db", F.col("id").alias("object_id"), "state",
        F.col("display_name").alias("_name"), F.col("number_of_days").alias("_days"),
        F.struct(
            F.col("id"), F.col("display_name"), F.col("state"), F.col("employee_id"), F.col("employee_name"),
            F.col("date_from").cast("string").alias("date_from"), F.col("date_to").cast("string").alias("date_to"),
            F.col("number_of_days"), F.col("holiday_status_name"),
        ).alias("_snapshot"),
    )


SHAPERS = {"invoice": invoice_objects, "expense": expense_objects, "leave": leave_objects}


def touched_objects(table: DataFrame, keys: DataFrame, kind: str, partners: DataFrame | None = None) -> DataFrame:
    """Rows of the object table named by ``keys`` (``db, object_id``), shaped for the fold.

    The semi-join comes first, so the table is streamed past the key set (AQE
    broadcasts it when small) and only the named rows meet the partner table."""
    named = table.join(keys.select("db", F.col("object_id").alias("id")), ["db", "id"], "left_semi")
    return SHAPERS[kind](named, partners)


def request_key(df: DataFrame, kind: str | None = None) -> Column:
    """Identity of a request: a hash of company, object type (``kind``, else the column), object, action,
    actor, time and ``request_id``. The id alone is a tracing field: one id may come with several objects."""
    parts = [F.col("db"), F.lit(kind) if kind else F.col("object_type"), F.col("object_id").cast("string"),
             F.col("action"), F.col("actor"), F.date_format("requested_at", "yyyy-MM-dd HH:mm:ss.SSSSSS"),
             F.col("request_id")]
    return F.sha2(F.to_json(F.array(*[p.cast("string") for p in parts])), 256)


def distinct_requests(requests: DataFrame, kind: str) -> DataFrame:
    """Requests with their identity ``_rk``, repeats of one identity merged (the smallest of the other fields)."""
    identity = ["request_id", "db", "object_id", "action", "actor", "requested_at"]
    other = [c for c in REQUEST_COLUMNS if c not in identity]
    one = requests.groupBy(*identity).agg(F.min(F.struct(*other)).alias("_other"))
    one = one.select(*identity, *[F.col(f"_other.{c}").alias(c) for c in other])
    return one.select(*REQUEST_COLUMNS, request_key(one, kind).alias("_rk"))


# --- the fold ----------------------------------------------------------------------------------

def _order_key() -> Column:
    # Request time (none: first), then id and identity, which make the order total.
    return F.struct(F.col("requested_at"), F.coalesce(F.col("request_id"), F.lit("")), F.col("_rk"))


def _firsts(req: DataFrame) -> DataFrame:
    k = _order_key()
    return req.groupBy("db", "object_id").agg(
        F.min(F.when(F.col("action") == "reject", k)).alias("_first_reject"),
        F.min(F.when(F.col("action") == "approve", k)).alias("_first_approve"),
    )


def transitions_of(kind: str, transitions: Mapping[str, Mapping[str, str]] | None) -> dict[str, str]:
    """New state per action: the defaults with the given ones put over them, action by action."""
    if kind not in DEFAULT_TRANSITIONS:
        raise ValueError(f"unknown object kind {kind!r}")
    given = dict((transitions or {}).get(kind, {}))
    unknown = set(given) - set(APPROVAL_ACTIONS)
    if unknown:
        raise ValueError(f"unknown actions in transitions: {sorted(unknown)}")
    out = {**DEFAULT_TRANSITIONS[kind], **given}
    if kind == "invoice" and out["reject"] == DRAFT:
        raise ValueError("an invoice that is rejected must leave draft")
    return out


def apply_approvals(requests: DataFrame, table: DataFrame, kind: str, partners: DataFrame | None = None,
                    transitions: Mapping[str, Mapping[str, str]] | None = None) -> DataFrame:
    """Outcome of every request in a batch, in request order per object.

    ``table`` is the object table (``account_move`` / ``hr_expense`` /
    ``hr_leave``); ``partners`` names invoice partners; ``transitions`` maps
    kind -> action -> new state. Repeats of one request (see ``request_key``) have one outcome."""
    return fold_requests(distinct_requests(requests, kind), table, kind, partners, transitions)


def fold_requests(allreq: DataFrame, table: DataFrame, kind: str, partners: DataFrame | None = None,
                  transitions: Mapping[str, Mapping[str, str]] | None = None) -> DataFrame:
    """``apply_approvals`` for the rows of ``distinct_requests``, which it reads several times."""
    t = transitions_of(kind, transitions)
    # A request whose action is not approve/reject is refused at validation: it gets
    # its own outcome and is invisible to the fold of the valid ones.
    valid = F.coalesce(F.col("action").isin(*APPROVAL_ACTIONS), F.lit(False))
    req = allreq.filter(valid)
    refused = allreq.filter(~valid).select(
        "request_id", "db", F.lit(kind).alias("object_type"), F.col("object_id").cast("string").alias("object_id"),
        "action", "actor", "actor_role", "reason", F.coalesce("source", F.lit(DEFAULT_SOURCE)).alias("source"),
        "requested_at", F.lit("invalid_request").alias("outcome"), F.lit(False).alias("success"),
        *[F.lit(None).cast("string").alias(c) for c in ("state_before", "new_state", "summary", "object_data")],
    )
    if kind in ("invoice", "expense"):
        firsts = _firsts(req)  # one row per named object
        per_object = firsts.join(touched_objects(table, firsts, kind, partners), ["db", "object_id"], "left")
        j = req.join(per_object, ["db", "object_id"], "left")
        k = _order_key()
        rejected_before = F.coalesce(F.col("_first_reject") < k, F.lit(False))
        approved_before = F.coalesce(F.col("_first_approve") < k, F.lit(False))
        if kind == "invoice":
            before = (F.when(rejected_before, F.lit(t["reject"]))
                      .when(approved_before & (F.col("state") == DRAFT), F.lit(t["approve"]))
                      .otherwise(F.col("state")))
        else:
            before = F.when(approved_before, F.lit(t["approve"])).otherwise(F.col("state"))
    elif kind == "leave":
        seq = with_previous(req.withColumn("_id", F.coalesce("request_id", F.lit(""))), ["db", "object_id"], ["requested_at", "_id", "_rk"],
                            {"action": "_prev_action"})
        keys = req.select("db", "object_id").distinct()
        j = seq.join(touched_objects(table, keys, kind, partners), ["db", "object_id"], "left")
        before = (F.when(F.col("_prev_action") == "approve", F.lit(t["approve"]))
                  .when(F.col("_prev_action") == "reject", F.lit(t["reject"]))
                  .otherwise(F.col("state")))
    else:
        raise ValueError(f"unknown object kind {kind!r}")

    j = j.withColumn("state_before", F.when(F.col("_snapshot").isNotNull(), before))
    found = F.col("_snapshot").isNotNull()
    sb, act = F.col("state_before"), F.col("action")
    if kind == "invoice":
        outcome = (F.when(~found, F.lit("not_found"))
                   .when(act == "reject", F.lit("success"))
                   .when(sb == POSTED, F.lit("already_approved"))
                   .when(sb != DRAFT, F.lit("invalid_state"))
                   .otherwise(F.lit("success")))
    else:
        outcome = F.when(~found, F.lit("not_found")).otherwise(F.lit("success"))
    j = j.withColumn("outcome", outcome)
    ok = F.col("outcome") == "success"
    new_state = F.when(ok, F.when(act == "approve", F.lit(t["approve"])).otherwise(F.lit(t["reject"])))
    past = F.when(act == "approve", F.lit(ACTION_PAST["approve"])).otherwise(F.lit(ACTION_PAST["reject"]))
    if kind == "invoice":
        summary = lf.fill(SUMMARY_INVOICE, name="_name", action=past,
                          partner=F.coalesce(F.col("_partner"), F.lit(UNKNOWN_PARTNER)), amount=lf.rupiah("_amount"))
    elif kind == "expense":
        summary = lf.fill(SUMMARY_EXPENSE, name="_name", action=past, amount=lf.rupiah("_amount"))
    else:
        summary = lf.fill(SUMMARY_LEAVE, name="_name", action=past, days="_days")
    snapshot = F.when(found, F.col("_snapshot").withField("state", sb))
    folded = j.select(
        "request_id", "db", F.lit(kind).alias("object_type"), F.col("object_id").cast("string").alias("object_id"),
        "action", "actor", "actor_role", "reason", F.coalesce("source", F.lit(DEFAULT_SOURCE)).alias("source"),
        "requested_at", "outcome", ok.alias("success"), "state_before", new_state.alias("new_state"),
        F.when(ok, summary).alias("summary"),
        F.to_json(snapshot, {"ignoreNullFields": "false"}).alias("object_data"),
    )
    return folded.unionByName(refused)


def new_states(outcomes: DataFrame) -> DataFrame:
    """State of each touched object after the batch (the last successful request that
    changes the object wins; an expense reject answers ``refused`` but changes nothing).

    ``max_by`` is an aggregate, so a hot object is combined per task first."""
    unchanged = F.lit(False)
    for kind, actions in UNCHANGED_BY.items():
        unchanged = unchanged | ((F.col("object_type") == kind) & F.col("action").isin(*actions))
    ok = outcomes.filter(F.col("success") & F.col("new_state").isNotNull() & ~unchanged)
    return ok.groupBy("db", "object_type", "object_id").agg(
        F.max_by("new_state", F.struct(F.col("requested_at"), F.coalesce("request_id", F.lit("")),
                                       request_key(ok))).alias("state"),
        F.max("requested_at").alias("changed_at"),
    )


# O-05
def audit_rows(outcomes: DataFrame, kind: str | None = None) -> DataFrame:
    """Audit log rows for successful requests, in the audit table layout.

    ``metadata`` carries ``{"reason": ...}`` for invoices with a reason and is
    NULL otherwise; ``id`` is the request's identity, which also guards against replays."""
    ok = outcomes.filter(F.col("success"))
    meta = F.when((F.col("object_type") == "invoice") & F.col("reason").isNotNull() & (F.col("reason") != ""),
                  F.to_json(F.struct(F.col("reason").alias("reason"))))
    return _audit(ok, F.col("object_data"), "success", F.lit(None).cast("string"), meta, F.col("actor_role"))


def failed_audit_rows(requests: DataFrame, kind: str, error_col: str = "error_message") -> DataFrame:
    """Audit log rows for requests that the ERP answered with an error (``error_col`` is not null).

    They carry the error and no object data; only invoice rows name the actor's role."""
    bad = requests.filter(F.col(error_col).isNotNull()).withColumn("object_type", F.lit(kind))
    role = F.col("actor_role") if kind == "invoice" else F.lit(None).cast("string")
    none = F.lit(None).cast("string")
    return _audit(bad, none, "failed", F.col(error_col), none, role)


def _audit(rows: DataFrame, data: Column, result: str, error: Column, meta: Column, role: Column) -> DataFrame:
    return rows.select(
        F.sha2(F.concat_ws("|", request_key(rows), F.lit(result)), 256).alias("id"),
        F.col("requested_at").cast("timestamp_ntz").alias("created_at"),
        F.concat_ws(".", "object_type", F.col("action")).alias("action_type"),
        "actor", role.alias("actor_role"), F.col("db").alias("odoo_db"), "object_type",
        F.col("object_id").cast("string").alias("object_id"), data.alias("object_data"),
        F.lit(result).alias("result"), error.alias("error_message"), meta.alias("metadata"),
        F.coalesce("source", F.lit(DEFAULT_SOURCE)).alias("source"), "request_id",
    )


def approval_messages(outcomes: DataFrame) -> DataFrame:
    """Outcomes with ``result`` (``success`` or ``failed``) and the ``error_message`` of each refusal."""
    label = F.initcap("object_type")
    message = (F.when(F.col("outcome") == "not_found", lf.fill(MESSAGE_NOT_FOUND, kind=label, id="object_id"))
               .when(F.col("outcome") == "already_approved", lf.fill(MESSAGE_ALREADY_APPROVED, kind=label, id="object_id"))
               .when(F.col("outcome") == "invalid_state", lf.fill(MESSAGE_INVALID_STATE, kind=label, id="object_id",
                                                                  state="state_before")))
    return (outcomes.withColumn("result", F.when(F.col("success"), F.lit("success")).otherwise(F.lit("failed")))
            .withColumn("error_message", message))


def rejection_notes(outcomes: DataFrame) -> DataFrame:
    """Chatter notes the ERP adds when an invoice is rejected with a reason (data effect of O-58)."""
    rej = outcomes.filter(F.col("success") & (F.col("object_type") == "invoice") & (F.col("action") == "reject")
                          & F.col("reason").isNotNull() & (F.col("reason") != ""))
    return rej.select(
        "db", F.lit("account.move").alias("model"), F.col("object_id").cast("bigint").alias("res_id"),
        F.concat(F.lit("<p>Rejected: "), F.col("reason"), F.lit("</p>")).alias("body"),
        F.lit("comment").alias("message_type"), "request_id", F.col("requested_at").alias("created_at"),
    )
