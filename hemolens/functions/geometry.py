"""Coordinates as columns: centring, rotation, distance."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hemolens.functions.ordered import join_all

AXES = ("x", "y", "z")


def center(df: DataFrame, key: Sequence[str] | str) -> DataFrame:
    """Subtract each group's centroid; the centroids are one small row per group."""
    keys = [key] if isinstance(key, str) else list(key)
    means = df.groupBy(*keys).agg(*[F.avg(a).alias(f"_{a}") for a in AXES])
    shifted = join_all(df, means, keys).withColumns({a: F.col(a) - F.col(f"_{a}") for a in AXES})
    return shifted.drop(*[f"_{a}" for a in AXES])


def rotate(df: DataFrame, angle_deg: Column | float, axis: str = "z") -> DataFrame:
    """Right-handed rotation about an axis through the origin; an unknown axis means z."""
    t = F.radians(F.lit(angle_deg) if isinstance(angle_deg, (int, float)) else angle_deg)
    c, s = F.cos(t), F.sin(t)
    fixed = axis if axis in AXES else "z"
    first, second = {"x": ("y", "z"), "y": ("z", "x"), "z": ("x", "y")}[fixed]
    u, v = F.col(first), F.col(second)
    return df.withColumns({first: u * c - v * s, second: u * s + v * c})


def translate(df: DataFrame, dx: Column | float, dy: Column | float, dz: Column | float) -> DataFrame:
    moves = zip(AXES, (dx, dy, dz))
    return df.withColumns({a: F.col(a) + (F.lit(d) if isinstance(d, (int, float)) else d) for a, d in moves})


def minimum_image(delta: Column, box: Column | float | None) -> Column:
    """Shortest separation along one periodic axis; no box means open edges."""
    if box is None:
        return delta
    length = F.lit(box) if isinstance(box, (int, float)) else box
    return delta - length * F.rint(delta / length)
