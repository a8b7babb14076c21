"""Registered queries: each operator run over the given tables, with the SQL that checks it."""

from __future__ import annotations

import importlib
import pkgutil


def load_all() -> None:
    """Import every family module so that its queries register themselves."""
    for mod in sorted(m.name for m in pkgutil.iter_modules(__path__)):
        importlib.import_module(f"{__name__}.{mod}")
