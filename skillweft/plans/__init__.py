"""Registered queries with their SQL counterparts."""

import importlib
import pkgutil


def load_catalogue():
    """Import every query module once and return (queries, sql)."""
    from skillweft.plans import registry

    for module in sorted(m.name for m in pkgutil.iter_modules(__path__)):
        importlib.import_module(f"{__name__}.{module}")
    return registry.QUERIES, registry.ORACLES
