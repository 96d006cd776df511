"""Registered queries, one module a family of operators."""

from __future__ import annotations

import importlib
import pkgutil


def load() -> None:
    """Import every module of this package, so that its queries are registered."""
    for m in pkgutil.iter_modules(__path__):
        importlib.import_module(f"{__name__}.{m.name}")
