"""Registered queries: operators bound to the given tables, with their SQL checks."""

from __future__ import annotations

import importlib

MODULES = (
    "lifecycles",
    "scans",
    "projections",
    "gates",
    "joins",
    "aggregates",
    "windows",
    "sets",
    "layout",
    "trajectory",
    "free_energy",
    "learning",
    "evaluation",
    "streams",
)


def registered():
    """(queries, SQL checks), after loading every plan module."""
    from hemolens.plans import catalog

    for name in MODULES:
        importlib.import_module(f"hemolens.plans.{name}")
    return catalog.QUERIES, catalog.ORACLES
