"""Registered queries, grouped by the operator families they exercise."""

from __future__ import annotations

import importlib
import pkgutil


def load_all() -> None:
    """Import every plan module so that its queries register themselves."""
    for module in sorted(m.name for m in pkgutil.iter_modules(__path__)):
        importlib.import_module(f"{__name__}.{module}")
