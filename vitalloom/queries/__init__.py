"""Runnable queries: each operator on the given tables, with its SQL twin."""

import importlib

MODULES = ("records", "filters", "joins", "aggregates", "windows", "texts", "extraction", "routing",
           "similarity", "composites", "streams", "quality")


def load_all() -> None:
    from importlib.util import find_spec
    for name in MODULES:
        if find_spec(f"{__name__}.{name}"):
            importlib.import_module(f"{__name__}.{name}")
