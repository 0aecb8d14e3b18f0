"""Connected components of an edge table, for the operators of this subpackage."""

from __future__ import annotations

from textloom.operators.graph import connected_components

__all__ = ["connected_components"]
