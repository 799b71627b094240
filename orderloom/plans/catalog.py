"""All registered queries."""

from __future__ import annotations

from importlib import import_module

from orderloom.plans.base import Registry

SECTIONS = (
    ("orderloom.plans.tables", "TABLES"),
    ("orderloom.plans.orders", "ORDERS"),
    ("orderloom.plans.explore", "EXPLORE"),
    ("orderloom.plans.business", "BUSINESS"),
    ("orderloom.plans.named_sql", "NAMED_SQL"),
    ("orderloom.plans.text", "TEXT"),
    ("orderloom.plans.reports", "REPORTS"),
    ("orderloom.plans.logs", "LOGS"),
)


def full_registry() -> Registry:
    registry = Registry()
    for module, name in SECTIONS:
        registry.merge(getattr(import_module(module), name))
    return registry
