"""All registered queries. Importing this module fills ``REGISTRY``."""

from __future__ import annotations

from ledgerflow.plans import (  # noqa: F401
    approval_queries, change_queries, chat_queries, digest_queries, list_queries, metrics_queries, stream_queries,
    time_queries, worklist_queries,
)
from ledgerflow.plans.registry import REGISTRY

FLAGSHIP = "sales_digest"

__all__ = ["REGISTRY", "FLAGSHIP"]
