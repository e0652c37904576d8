"""Registered queries over the test tables and their SQL counterparts."""

from __future__ import annotations

from importlib import import_module

_MODULES = ["features", "reports", "learning", "files", "streams"]


def _registry():
    for name in _MODULES:
        import_module(f"flowlens.plans.{name}")
    return import_module("flowlens.plans.registry")


def queries() -> dict:
    return dict(_registry().QUERIES)


def oracle_sql() -> dict:
    return dict(_registry().SQL)
