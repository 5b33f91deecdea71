"""Every operator as a query over the given tables."""

from importlib import import_module

from tablewright.catalog.registry import ORACLES, QUERIES

MODULES = [
    "scans",
    "selections",
    "joins",
    "aggregations",
    "scalars",
    "encoders",
    "statistics",
    "streams",
    "models",
    "preparation",
]

for _module in MODULES:
    import_module(f"tablewright.catalog.{_module}")

__all__ = ["ORACLES", "QUERIES"]
