"""Operators for language-model training data; nothing outside this package imports it."""

from __future__ import annotations

import importlib
import pkgutil


def query_modules() -> list:
    """The modules of this package that register queries, in order of name."""
    found = [importlib.import_module(f"{__name__}.{m.name}") for m in pkgutil.iter_modules(__path__)]
    return [m for m in found if hasattr(m, "QUERIES")]
