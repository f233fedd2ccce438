"""All registered queries."""

from __future__ import annotations

import importlib

from marginalia.catalog.base import ENTRIES, Entry

MODULES = ["text_queries", "vault_queries", "spend_queries", "page_queries", "ledger_queries", "decide_queries", "learn_queries", "objective_queries", "review_queries", "code_queries", "stream_queries", "workflow_queries", "state_queries"]


def load() -> dict[str, Entry]:
    for name in MODULES:
        importlib.import_module(f"marginalia.catalog.{name}")
    return ENTRIES
