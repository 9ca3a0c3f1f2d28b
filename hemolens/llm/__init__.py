"""Operators for preparing training text, and their queries; nothing else in the library uses them."""

from __future__ import annotations


def registered():
    """(queries, SQL checks) of this subpackage."""
    from hemolens.llm import queries

    return queries.QUERIES, queries.ORACLES
