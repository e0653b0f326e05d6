"""Chat command log parsing (O-90) and user group facts (O-91), as column expressions.

``parse_commands`` routes every logged slash command the way the chat service
does: command and subcommand, the arguments each handler reads with their
defaults, and the usage / unknown-command error text. It is a stateless
``select``, so it runs unchanged on a stream.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerflow.constants import BUSINESS_UNIT_PREFIX, CHAT_LEADS_DEFAULT, DEFAULT_COMPANY, ROLE_PREFIX, SERVICE_ROLE

# --- fixed values: usage and error texts of the chat commands --------------------------------------
USAGE_ERP_INVOICE = "Usage: /erp invoice <id> [db]"
USAGE_FRAPPE_ORDER = "Usage: /frappe order <order_id>"
USAGE_FRAPPE_DOC = "Usage: /frappe doc <doctype> <name>"
USAGE_FRAPPE_CUSTOMER = "Usage: /frappe crm customer <name>"
USAGE_METABASE_DASHBOARD = "Usage: /metabase dashboard <name|id>"
USAGE_METABASE_QUESTION = "Usage: /metabase question <id>"
USAGE_ACCESS_REQUEST = "Usage: /access request <app>"
UNKNOWN_SUBCOMMAND = {
    "erp": "Unknown ERP subcommand: ",
    "hr": "Unknown HR subcommand: ",
    "frappe": "Unknown Frappe subcommand: ",
    "metabase": "Unknown Metabase subcommand: ",
    "access": "Unknown access subcommand: ",
}
UNKNOWN_COMMAND = "Unknown command: /"
UNKNOWN_LEAVE_ACTION = "Unknown leave action: "
UNKNOWN_CRM_ACTION = "Unknown CRM action: "

#: White space that separates words of a command, as a character class: ASCII controls, spaces, and Unicode's.
SPACE = "[\\x{9}-\\x{D}\\x{1C}-\\x{20}\\x{85}\\x{A0}\\x{1680}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}]"

OUTPUT_FIELDS = ("handler", "object_id", "db", "period", "action", "arg", "lead_limit", "doctype", "query", "error")


def _s(x: str) -> Column:
    return F.lit(x)


def _null() -> Column:
    return F.lit(None).cast("string")


def _routes(sub: Column, n: Column, p1: Column, p2: Column, rest: Column, cmd: Column) -> dict[str, dict[str, Column]]:
    """Per command: the output fields as Columns (rows of other commands are masked later)."""
    def usage(cond: Column, msg: str, handler: str) -> tuple[Column, Column]:
        return F.when(cond, _s("error")).otherwise(_s(handler)), F.when(cond, _s(msg))

    # erp
    erp_h_inv, erp_e_inv = usage(n < 2, USAGE_ERP_INVOICE, "erp_invoice")
    erp = {
        "handler": (F.when(sub == "invoice", erp_h_inv).when(sub == "pending", _s("erp_pending"))
                    .when(sub == "sales", _s("erp_sales")).otherwise(_s("error"))),
        "object_id": F.when((sub == "invoice") & (n >= 2), p1),
        "db": (F.when((sub == "invoice") & (n >= 2), F.coalesce(p2, _s(DEFAULT_COMPANY)))
               .when(sub == "pending", F.coalesce(p1, _s(DEFAULT_COMPANY)))
               .when(sub == "sales", F.coalesce(p2, _s(DEFAULT_COMPANY)))),
        "period": F.when(sub == "sales", F.coalesce(p1, _s("today"))),
        "error": (F.when(sub == "invoice", erp_e_inv)
                  .when(~sub.isin("pending", "sales"), F.concat(_s(UNKNOWN_SUBCOMMAND["erp"]), sub))),
    }
    # hr
    leave_action = F.coalesce(p1, _s("status"))
    hr = {
        "handler": (F.when(sub == "leave", F.when(leave_action.isin("status", "pending"), _s("hr_leave"))
                           .otherwise(_s("error")))
                    .when(sub == "pending", _s("hr_pending")).otherwise(_s("error"))),
        "action": F.when(sub == "leave", leave_action),
        "error": (F.when(sub == "leave", F.when(~leave_action.isin("status", "pending"),
                                               F.concat(_s(UNKNOWN_LEAVE_ACTION), leave_action)))
                  .when(sub != "pending", F.concat(_s(UNKNOWN_SUBCOMMAND["hr"]), sub))),
    }
    # frappe
    crm_action = F.coalesce(p1, _s("leads"))
    crm_ok = (crm_action == "leads") | ((crm_action == "customer") & p2.isNotNull())
    crm_err = (F.when((crm_action == "customer") & p2.isNull(), _s(USAGE_FRAPPE_CUSTOMER))
               .when(~crm_action.isin("leads", "customer"), F.concat(_s(UNKNOWN_CRM_ACTION), crm_action)))
    f_h_ord, f_e_ord = usage(n < 2, USAGE_FRAPPE_ORDER, "frappe_order")
    f_h_doc, f_e_doc = usage(n < 3, USAGE_FRAPPE_DOC, "frappe_doc")
    frappe = {
        "handler": (F.when(sub == "crm", F.when(crm_ok, _s("frappe_crm")).otherwise(_s("error")))
                    .when(sub == "order", f_h_ord).when(sub == "doc", f_h_doc).otherwise(_s("error"))),
        "action": F.when(sub == "crm", crm_action),
        "arg": F.when(sub == "crm", p2),
        "lead_limit": F.when((sub == "crm") & (crm_action == "leads"),
                             F.when(p2.rlike("^[0-9]+$"), F.expr("try_cast(_p2 AS BIGINT)"))
                             .otherwise(F.lit(CHAT_LEADS_DEFAULT).cast("bigint"))),
        "object_id": F.when((sub == "order") & (n >= 2), p1).when((sub == "doc") & (n >= 3), p2),
        "doctype": F.when((sub == "doc") & (n >= 3), p1),
        "error": (F.when(sub == "crm", crm_err).when(sub == "order", f_e_ord).when(sub == "doc", f_e_doc)
                  .otherwise(F.concat(_s(UNKNOWN_SUBCOMMAND["frappe"]), sub))),
    }
    # metabase
    m_h_dash, m_e_dash = usage(n < 2, USAGE_METABASE_DASHBOARD, "metabase_dashboard")
    m_h_q, m_e_q = usage(n < 2, USAGE_METABASE_QUESTION, "metabase_question")
    metabase = {
        "handler": (F.when(sub == "dashboard", m_h_dash).when(sub == "question", m_h_q)
                    .when(sub == "search", _s("metabase_search")).otherwise(_s("error"))),
        "object_id": F.when((sub == "question") & (n >= 2), p1),
        "query": (F.when((sub == "dashboard") & (n >= 2), rest)
                  .when(sub == "search", F.when(n > 1, rest).otherwise(_s("")))),
        "error": (F.when(sub == "dashboard", m_e_dash).when(sub == "question", m_e_q)
                  .when(sub != "search", F.concat(_s(UNKNOWN_SUBCOMMAND["metabase"]), sub))),
    }
    # access
    a_h_req, a_e_req = usage(n < 2, USAGE_ACCESS_REQUEST, "access_request")
    access = {
        "handler": (F.when(sub == "request", a_h_req).when(sub == "status", _s("access_status"))
                    .otherwise(_s("error"))),
        "query": F.when((sub == "request") & (n >= 2), p1),
        "error": (F.when(sub == "request", a_e_req)
                  .when(sub != "status", F.concat(_s(UNKNOWN_SUBCOMMAND["access"]), sub))),
    }
    return {"erp": erp, "hr": hr, "frappe": frappe, "metabase": metabase, "access": access}


def parse_commands(log: DataFrame, command_col: str = "command", text_col: str = "text") -> DataFrame:
    """Route every command row; keeps the input columns and adds ``subcommand`` plus ``OUTPUT_FIELDS``.

    ``command`` is replaced by its normal form (lower case, no leading or
    trailing ``/``); ``text`` by its trimmed form. Words are separated by Unicode
    white space. A missing command is an unknown one with an empty name."""
    cmd = F.regexp_replace(F.lower(F.coalesce(F.col(command_col), F.lit(""))), r"^/+|/+$", "")
    txt = F.regexp_replace(F.coalesce(F.col(text_col), F.lit("")), f"^{SPACE}+|{SPACE}+$", "")
    base = log.withColumn("_cmd", cmd).withColumn("_txt", txt)
    parts = F.split(F.col("_txt"), f"{SPACE}+")
    base = (base.withColumn("_n", F.when(F.col("_txt") == "", F.lit(0)).otherwise(F.size(parts)))
            .withColumn("_parts", parts))
    n = F.col("_n")
    base = (base.withColumn("_p1", F.when(n > 1, F.get(F.col("_parts"), 1)))
            .withColumn("_p2", F.when(n > 2, F.get(F.col("_parts"), 2)))
            .withColumn("_sub", F.when(n > 0, F.lower(F.get(F.col("_parts"), 0))).otherwise(F.lit("help")))
            .withColumn("_rest", F.array_join(F.slice(F.col("_parts"), 2, F.greatest(n - 1, F.lit(1))), " ")))
    sub, p1, p2, rest, c = F.col("_sub"), F.col("_p1"), F.col("_p2"), F.col("_rest"), F.col("_cmd")
    routes = _routes(sub, n, p1, p2, rest, c)
    is_help = sub == "help"
    out_cols = []
    for field in OUTPUT_FIELDS:
        expr = None
        for name, fields in routes.items():
            if field == "handler":
                v = F.when(is_help, _s(f"{name}_help")).otherwise(fields["handler"])
            elif field in fields:
                v = F.when(~is_help, fields[field])
            else:
                continue
            expr = (F.when(c == name, v) if expr is None else expr.when(c == name, v))
        if field == "handler":
            expr = expr.otherwise(_s("error"))
        elif field == "error":
            expr = expr.otherwise(F.concat(_s(UNKNOWN_COMMAND), c))
        if field == "lead_limit":
            expr = expr.cast("bigint") if expr is not None else F.lit(None).cast("bigint")
        elif expr is None:
            expr = _null()
        out_cols.append(expr.alias(field))
    keep = [F.col(x) for x in log.columns if x not in (command_col, text_col)]
    known = c.isin(*routes.keys())
    return base.select(*keep, c.alias(command_col), F.col("_txt").alias(text_col),
                       F.when(known, sub).alias("subcommand"), *out_cols)


def user_facts(users: DataFrame, groups_col: str = "groups", unit_prefix: str = BUSINESS_UNIT_PREFIX,
               role_prefix: str = ROLE_PREFIX) -> DataFrame:
    """O-91: business unit (first ``ak-bu-*`` group), roles (every ``ak-role-*``), the user name (the
    ``preferred_username`` column where there is one, else the e-mail), and the actor and actor role used
    for audit rows (the e-mail; the first role, else ``service``). Missing groups are no groups."""
    g = F.col(groups_col)
    if users.schema[groups_col].dataType.simpleString() == "string":
        g = F.array(g)
    g = F.filter(F.coalesce(g, F.array().cast("array<string>")), lambda x: x.isNotNull())
    bu = F.get(F.filter(g, lambda x: x.startswith(unit_prefix)), 0)
    roles = F.transform(F.filter(g, lambda x: x.startswith(role_prefix)),
                        lambda x: F.replace(x, F.lit(role_prefix), F.lit("")))
    email = F.coalesce(F.col("email"), F.lit("")) if "email" in users.columns else F.lit("")
    name = F.coalesce(F.col("preferred_username"), email) if "preferred_username" in users.columns else email
    return users.select(
        *users.columns,
        F.coalesce(F.replace(bu, F.lit(unit_prefix), F.lit("")), F.lit("")).alias("business_unit"),
        roles.alias("roles"),
        F.coalesce(F.get(roles, 0), F.lit(SERVICE_ROLE)).alias("actor_role"),
        name.alias("username"), email.alias("actor"),
    )
