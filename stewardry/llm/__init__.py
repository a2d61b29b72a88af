"""Operators for training text; nothing outside this package imports it."""

from __future__ import annotations

import importlib

#: The modules that hold queries and their SQL.
MODULES: tuple[str, ...] = ("pii_queries", "bitmap_queries", "markup_queries", "packing_queries", "mixing_queries", "looks_queries")


def query_modules() -> list:
    return [importlib.import_module(f"{__name__}.{m}") for m in MODULES]
