"""Queries over the operators; importing this package registers them all."""

from importlib import import_module
from pkgutil import iter_modules

for _found in iter_modules(__path__):
    import_module(f"{__name__}.{_found.name}")
