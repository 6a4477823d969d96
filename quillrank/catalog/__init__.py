"""Registered queries over the shared tables, each next to its SQL twin."""

from __future__ import annotations

import importlib

_MODULES = ("scoring", "selection", "extraction", "state", "streams", "reports")


def registry() -> dict:
    """name → (query, SQL or None)."""
    found: dict = {}
    for module in _MODULES:
        found |= importlib.import_module(f"quillrank.catalog.{module}").QUERIES
    return found
