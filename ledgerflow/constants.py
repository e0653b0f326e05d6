"""Fixed values of the ERP domain.

Everything in this module is a fixed value that results depend on: company
codes, state names, thresholds, default limits and message texts. They are
stated once here, in natural order, and imported everywhere else.
"""

from __future__ import annotations

# --- fixed values: companies -------------------------------------------------
COMPANIES: tuple[str, ...] = ("tln_db", "ieg_db", "tmi_db")
DEFAULT_COMPANY = "tln_db"

# --- fixed values: enumerations ----------------------------------------------
APPROVAL_ACTIONS: tuple[str, ...] = ("approve", "reject")
APPROVAL_RESULTS: tuple[str, ...] = ("success", "failed", "denied")
OBJECT_TYPES: tuple[str, ...] = ("invoice", "expense", "leave")
OBJECT_STATES: tuple[str, ...] = ("draft", "open", "posted", "paid", "cancel", "approved", "rejected")
ACTION_SOURCES: tuple[str, ...] = ("n8n", "mattermost", "api")
DIGEST_TYPES: tuple[str, ...] = ("sales_daily", "finance_daily", "ops_daily")
ALERT_TYPES: tuple[str, ...] = ("info", "warning", "critical")
PRIORITIES: tuple[str, ...] = ("low", "medium", "high", "critical")

# --- fixed values: state sets used by the queries -----------------------------
SALE_STATES: tuple[str, ...] = ("sale", "done")
DRAFT_ORDER_STATE = "draft"
PENDING_DELIVERY_STATES: tuple[str, ...] = ("confirmed", "assigned")
CUSTOMER_MOVE_TYPES: tuple[str, ...] = ("out_invoice", "out_refund")
POSTED = "posted"
DRAFT = "draft"
CANCEL = "cancel"

# --- fixed values: money and day thresholds -----------------------------------
HIGH_AMOUNT = 100_000_000
MEDIUM_AMOUNT = 50_000_000
RISK_HIGH_COUNT = 5
RISK_MEDIUM_COUNT = 2
PENDING_HIGH_DAYS = 7
PENDING_MEDIUM_DAYS = 3
OVERDUE_CRITICAL_DAYS = 30
OVERDUE_HIGH_DAYS = 14
OVERDUE_MEDIUM_DAYS = 7
SEVERE_OVERDUE_DAYS = 30
OPS_ALERT_MIN = 10

# --- fixed values: default limits ---------------------------------------------
OVERDUE_LIMIT = 100
PENDING_LIMIT = 100
WORKLIST_LIMIT = 20
WORKLIST_OVERDUE_THRESHOLD = 14
TOP_PRODUCTS_LIMIT = 5
LIST_PAGE_LENGTH = 20
CUSTOMER_SEARCH_LIMIT = 10
CRM_LEADS_LIMIT = 20
RECENT_AUDIT_LIMIT = 100
CHAT_LEADS_DEFAULT = 5

# --- fixed values: texts and defaults -----------------------------------------
CURRENCY_CODE = "IDR"
UNKNOWN_PARTNER = "Unknown"
DEFAULT_LEAVE_TYPE = "Leave"
MANAGER_ROLE = "manager"
SERVICE_ROLE = "service"
DEFAULT_SOURCE = "api"
LOCAL_TZ = "Asia/Jakarta"
BUSINESS_UNIT_PREFIX = "ak-bu-"
ROLE_PREFIX = "ak-role-"
NOT_AVAILABLE = "N/A"
PLUS_INFINITY = "+∞"

# --- fixed values: digest alert and approval summary texts ------------------------
# ``{name}`` marks a value filled in per row (see ``functions.fill``).
ALERT_NO_ORDERS = "No orders today"
ALERT_SALES_DOWN = "Sales down {comparison} vs yesterday"
ALERT_PENDING_ORDERS = "{count} orders pending confirmation"
ALERT_OVERDUE = "{count} invoices overdue (Rp {amount})"
ALERT_SEVERE_OVERDUE = "{count} invoices >30 days overdue (Rp {amount})"
ALERT_ORDERS_AWAITING = "{count} orders awaiting confirmation"
ALERT_DELIVERIES_PENDING = "{count} deliveries pending"
SUMMARY_INVOICE = "Invoice {name} {action} ({partner}, Rp {amount})"
SUMMARY_EXPENSE = "Expense {name} {action} (Rp {amount})"
SUMMARY_LEAVE = "Leave {name} {action} ({days} days)"

# Past tense used in approval summaries ("reject" + "d" is not a word).
ACTION_PAST = {"approve": "approved", "reject": "rejected"}

# State after a successful action, per object kind. The ERP re-reads these, so
# they are parameters; these are the defaults.
DEFAULT_TRANSITIONS: dict[str, dict[str, str]] = {
    "invoice": {"approve": "posted", "reject": "cancel"},
    "expense": {"approve": "approved", "reject": "refused"},
    "leave": {"approve": "approved", "reject": "rejected"},
}

# Actions that answer with a new state but leave the object as it is.
UNCHANGED_BY: dict[str, tuple[str, ...]] = {"expense": ("reject",)}

# Actions offered per object state.
INVOICE_ACTIONABLE_STATES: tuple[str, ...] = ("draft",)
INVOICE_VIEW_ONLY_STATES: tuple[str, ...] = ("posted", "cancel")
EXPENSE_ACTIONABLE_STATES: tuple[str, ...] = ("draft", "reported")
LEAVE_ACTIONABLE_STATES: tuple[str, ...] = ("confirm",)
FULL_ACTIONS: tuple[str, ...] = ("approve", "reject", "view")
VIEW_ACTIONS: tuple[str, ...] = ("view",)

# Refusal messages of approval requests (fixed text)
MESSAGE_NOT_FOUND = "{kind} {id} not found"
MESSAGE_ALREADY_APPROVED = "{kind} {id} is already approved"
MESSAGE_INVALID_STATE = "{kind} {id} cannot be approved in state {state}"
