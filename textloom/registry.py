"""All queries over the supplied tables and the SQL that gives the same rows."""

from __future__ import annotations

from importlib import import_module

from textloom.plans.base import ORACLES, QUERIES

for _plan in ("text", "glossary", "translation", "layout", "records", "streams", "more"):
    import_module(f"textloom.plans.{_plan}")

__all__ = ["ORACLES", "QUERIES"]
