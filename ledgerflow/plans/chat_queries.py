"""Registered chat queries (O-90, O-91) with their DuckDB oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerflow.operators import chat
from ledgerflow.plans.registry import register

PARSE_COMMANDS_SQL = r"""
, c AS (SELECT conv_id, turn, user_name, regexp_replace(lower(command), '^/+|/+$', '', 'g') AS cmd,
               regexp_replace(coalesce(text, ''), '^\s+|\s+$', '', 'g') AS txt FROM command_log),
  p AS (SELECT *, CASE WHEN txt = '' THEN CAST([] AS VARCHAR[]) ELSE string_split_regex(txt, '\s+') END AS parts
        FROM c),
  q AS (SELECT *, len(parts) AS n, CASE WHEN len(parts) > 0 THEN lower(parts[1]) ELSE 'help' END AS sub,
               parts[2] AS p1, parts[3] AS p2, array_to_string(parts[2:], ' ') AS rest FROM p)
SELECT conv_id, turn, user_name, cmd AS command, txt AS text,
  CASE WHEN cmd IN ('erp', 'hr', 'frappe', 'metabase', 'access') THEN sub END AS subcommand,
  CASE WHEN cmd NOT IN ('erp', 'hr', 'frappe', 'metabase', 'access') THEN 'error'
       WHEN sub = 'help' THEN cmd || '_help'
       WHEN cmd = 'erp' THEN CASE WHEN sub = 'invoice' THEN (CASE WHEN n < 2 THEN 'error' ELSE 'erp_invoice' END)
                                  WHEN sub = 'pending' THEN 'erp_pending' WHEN sub = 'sales' THEN 'erp_sales'
                                  ELSE 'error' END
       WHEN cmd = 'hr' THEN CASE WHEN sub = 'leave' THEN (CASE WHEN coalesce(p1, 'status') IN ('status', 'pending')
                                                               THEN 'hr_leave' ELSE 'error' END)
                                 WHEN sub = 'pending' THEN 'hr_pending' ELSE 'error' END
       WHEN cmd = 'frappe' THEN CASE WHEN sub = 'crm' THEN (CASE WHEN coalesce(p1, 'leads') = 'leads'
                                          OR (coalesce(p1, 'leads') = 'customer' AND p2 IS NOT NULL)
                                          THEN 'frappe_crm' ELSE 'error' END)
                                     WHEN sub = 'order' THEN (CASE WHEN n < 2 THEN 'error' ELSE 'frappe_order' END)
                                     WHEN sub = 'doc' THEN (CASE WHEN n < 3 THEN 'error' ELSE 'frappe_doc' END)
                                     ELSE 'error' END
       WHEN cmd = 'metabase' THEN CASE WHEN sub = 'dashboard' THEN (CASE WHEN n < 2 THEN 'error'
                                                                         ELSE 'metabase_dashboard' END)
                                       WHEN sub = 'question' THEN (CASE WHEN n < 2 THEN 'error'
                                                                        ELSE 'metabase_question' END)
                                       WHEN sub = 'search' THEN 'metabase_search' ELSE 'error' END
       ELSE CASE WHEN sub = 'request' THEN (CASE WHEN n < 2 THEN 'error' ELSE 'access_request' END)
                 WHEN sub = 'status' THEN 'access_status' ELSE 'error' END
  END AS handler,
  CASE WHEN sub = 'help' THEN NULL
       WHEN cmd = 'erp' AND sub = 'invoice' AND n >= 2 THEN p1
       WHEN cmd = 'frappe' AND sub = 'order' AND n >= 2 THEN p1
       WHEN cmd = 'frappe' AND sub = 'doc' AND n >= 3 THEN p2
       WHEN cmd = 'metabase' AND sub = 'question' AND n >= 2 THEN p1 END AS object_id,
  CASE WHEN sub = 'help' OR cmd <> 'erp' THEN NULL
       WHEN sub = 'invoice' AND n >= 2 THEN coalesce(p2, 'tln_db')
       WHEN sub = 'pending' THEN coalesce(p1, 'tln_db')
       WHEN sub = 'sales' THEN coalesce(p2, 'tln_db') END AS db,
  CASE WHEN cmd = 'erp' AND sub = 'sales' THEN coalesce(p1, 'today') END AS period,
  CASE WHEN cmd = 'hr' AND sub = 'leave' THEN coalesce(p1, 'status')
       WHEN cmd = 'frappe' AND sub = 'crm' THEN coalesce(p1, 'leads') END AS action,
  CASE WHEN cmd = 'frappe' AND sub = 'crm' THEN p2 END AS arg,
  CASE WHEN cmd = 'frappe' AND sub = 'crm' AND coalesce(p1, 'leads') = 'leads'
       THEN (CASE WHEN regexp_full_match(coalesce(p2, ''), '[0-9]+') THEN TRY_CAST(p2 AS BIGINT) ELSE 5 END)
       END AS lead_limit,
  CASE WHEN cmd = 'frappe' AND sub = 'doc' AND n >= 3 THEN p1 END AS doctype,
  CASE WHEN sub = 'help' THEN NULL
       WHEN cmd = 'metabase' AND sub = 'dashboard' AND n >= 2 THEN rest
       WHEN cmd = 'metabase' AND sub = 'search' THEN (CASE WHEN n > 1 THEN rest ELSE '' END)
       WHEN cmd = 'access' AND sub = 'request' AND n >= 2 THEN p1 END AS query,
  CASE WHEN cmd NOT IN ('erp', 'hr', 'frappe', 'metabase', 'access') THEN 'Unknown command: /' || cmd
       WHEN sub = 'help' THEN NULL
       WHEN cmd = 'erp' THEN CASE WHEN sub = 'invoice' THEN (CASE WHEN n < 2 THEN 'Usage: /erp invoice <id> [db]' END)
                                  WHEN sub IN ('pending', 'sales') THEN NULL
                                  ELSE 'Unknown ERP subcommand: ' || sub END
       WHEN cmd = 'hr' THEN CASE WHEN sub = 'leave' THEN (CASE WHEN coalesce(p1, 'status') NOT IN ('status', 'pending')
                                                               THEN 'Unknown leave action: ' || p1 END)
                                 WHEN sub = 'pending' THEN NULL ELSE 'Unknown HR subcommand: ' || sub END
       WHEN cmd = 'frappe' THEN CASE WHEN sub = 'crm' THEN (
                                          CASE WHEN coalesce(p1, 'leads') = 'customer' AND p2 IS NULL
                                               THEN 'Usage: /frappe crm customer <name>'
                                               WHEN coalesce(p1, 'leads') NOT IN ('leads', 'customer')
                                               THEN 'Unknown CRM action: ' || p1 END)
                                     WHEN sub = 'order' THEN (CASE WHEN n < 2 THEN 'Usage: /frappe order <order_id>' END)
                                     WHEN sub = 'doc' THEN (CASE WHEN n < 3 THEN 'Usage: /frappe doc <doctype> <name>' END)
                                     ELSE 'Unknown Frappe subcommand: ' || sub END
       WHEN cmd = 'metabase' THEN CASE WHEN sub = 'dashboard' THEN (CASE WHEN n < 2
                                                                         THEN 'Usage: /metabase dashboard <name|id>' END)
                                       WHEN sub = 'question' THEN (CASE WHEN n < 2 THEN 'Usage: /metabase question <id>' END)
                                       WHEN sub = 'search' THEN NULL ELSE 'Unknown Metabase subcommand: ' || sub END
       ELSE CASE WHEN sub = 'request' THEN (CASE WHEN n < 2 THEN 'Usage: /access request <app>' END)
                 WHEN sub = 'status' THEN NULL ELSE 'Unknown access subcommand: ' || sub END
  END AS error
FROM q
"""


@register("parse_commands", ["command_log"], PARSE_COMMANDS_SQL)
def parse_commands(fx):
    """O-90: every logged chat command routed to its handler, with arguments, defaults and errors."""
    return chat.parse_commands(fx["command_log"])


@register("user_facts", ["user_groups"], """
SELECT user_id, email, array_to_string(groups, ',') AS groups,
       coalesce(replace(list_filter(groups, lambda g: starts_with(g, 'ak-bu-'))[1], 'ak-bu-', ''), '') AS business_unit,
       array_to_string(list_transform(list_filter(groups, lambda g: starts_with(g, 'ak-role-')),
                                      lambda g: replace(g, 'ak-role-', '')), ',') AS roles,
       coalesce(list_transform(list_filter(groups, lambda g: starts_with(g, 'ak-role-')),
                               lambda g: replace(g, 'ak-role-', ''))[1], 'service') AS actor_role,
       email AS username, email AS actor
FROM user_groups
""")
def user_facts(fx):
    """O-91: business unit, roles and audit actor role of every user."""
    out = chat.user_facts(fx["user_groups"])
    return out.select("user_id", "email", F.array_join("groups", ",").alias("groups"), "business_unit",
                      F.array_join("roles", ",").alias("roles"), "actor_role", "username", "actor")
