"""Check queries: the registered results written as plain SQL over the given tables."""
from __future__ import annotations

import importlib
import pkgutil

from .base import compose, register, rnd, tolong, views


def all_sql() -> dict[str, str]:
    out: dict[str, str] = {}
    for info in pkgutil.iter_modules(__path__):
        out.update(getattr(importlib.import_module(f"{__name__}.{info.name}"), "SQL", {}))
    return out


__all__ = ["all_sql", "compose", "register", "rnd", "tolong", "views"]
