"""Registered queries with the SQL each one is checked against."""

import importlib

MODULES = (
    "cleaning",
    "aggregates",
    "lifecycle",
    "business",
    "encoding",
    "evaluation",
    "segmentation",
    "attribution",
    "streams",
    "files",
    "training",
)


def load() -> tuple[dict, dict]:
    """(queries, oracles) of all catalog modules; importing a module registers its queries."""
    from holdfast.catalog import registry

    for module in MODULES:
        importlib.import_module(f"{__name__}.{module}")
    return registry.QUERIES, registry.ORACLES
