"""Queries over the given tables, one per operator or job."""

import importlib

MODULES = ("labels", "vectors", "splits", "aggregates", "metrics", "jobs", "frames", "ablations", "stores")


def load():
    for m in MODULES:
        importlib.import_module(f"tessella.catalog.{m}")
    from tessella.catalog.registry import QUERIES

    return QUERIES
