"""All registered queries with their SQL."""

from __future__ import annotations

from . import documents, listings, measures, outputs, records, rules, series, snapshots, streams  # noqa: F401  they register themselves
from .model import REGISTRY


def queries() -> dict:
    return {name: f for name, (f, _) in REGISTRY.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in REGISTRY.items() if sql}
