"""All registered queries and the SQL each is checked against."""

from __future__ import annotations

import importlib

from marginalia.plans.fixtures import with_views

GROUPS = ("usage", "text", "lifecycle", "rag", "platform", "sources", "streams")


def _groups():
    return [importlib.import_module(f"marginalia.plans.{name}") for name in GROUPS]


def queries():
    return {name: make for group in _groups() for name, make in group.QUERIES.items()}


def oracle_sql():
    return {
        name: with_views(sql, getattr(group, "EXTRA", None))
        for group in _groups() for name, sql in group.ORACLES.items()
    }
