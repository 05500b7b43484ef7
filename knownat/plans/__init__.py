"""Registered queries over the given tables, one module per operator family."""

from __future__ import annotations

import importlib
import pkgutil

from knownat.plans.registry import ORACLES, QUERIES


def _load() -> None:
    for module in sorted(m.name for m in pkgutil.iter_modules(__path__)):
        importlib.import_module(f"{__name__}.{module}")


def queries() -> dict:
    _load()
    return dict(QUERIES)


def oracle_sql() -> dict:
    _load()
    return dict(ORACLES)
