"""Queries of this folder and, where SQL can express them, their SQL."""

from __future__ import annotations

import importlib
import pkgutil

import strandline.llm as folder


def _modules():
    for m in pkgutil.iter_modules(folder.__path__):
        if m.name.startswith("query_"):
            yield importlib.import_module(f"strandline.llm.{m.name}")


def queries() -> dict:
    return {k: f for m in _modules() for k, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: s for m in _modules() for k, s in getattr(m, "SQL", {}).items()}
