"""Deterministic pseudo-random numbers from md5, equal in any engine that has md5."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def hash_text(*parts: Column | str) -> Column:
    """Parts joined by `|`; plain strings are column names."""
    cols = [F.col(p) if isinstance(p, str) else p for p in parts]
    return F.md5(F.concat_ws("|", *[c.cast("string") for c in cols]))


def draw32(*parts: Column | str) -> Column:
    """Uniform integer in [0, 2^32)."""
    return F.conv(F.substring(hash_text(*parts), 1, 8), 16, 10).cast("long")


def draw_unit(*parts: Column | str) -> Column:
    """Uniform double in [0, 1)."""
    return draw32(*parts) / F.lit(4294967296.0)


def draw_index(n: Column | int, *parts: Column | str) -> Column:
    """Uniform integer in [0, n)."""
    n = F.lit(n) if isinstance(n, int) else n
    return draw32(*parts) % n
