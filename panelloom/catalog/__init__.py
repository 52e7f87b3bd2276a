"""All registered queries and oracles."""
from __future__ import annotations

from importlib import import_module

from . import base

MODULES = ["tables", "log_queries", "label_queries", "state_queries", "eval_queries", "analysis_queries", "misc_queries", "model_queries", "report_queries"]


def _load() -> None:
    for m in MODULES:
        import_module(f"{__name__}.{m}")


def queries() -> dict:
    _load()
    return dict(base.QUERIES)


def oracle_sql() -> dict:
    _load()
    return {name: base.with_tables(sql) for name, sql in base.ORACLES.items()}
