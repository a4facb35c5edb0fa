"""Registered queries over the driver's tables."""

from importlib import import_module
from pkgutil import iter_modules


def load():
    """Import every query module and return the registry."""
    for module in iter_modules(__path__):
        if module.name.startswith("q_"):
            import_module(f"{__name__}.{module.name}")
    return import_module(f"{__name__}.registry")
