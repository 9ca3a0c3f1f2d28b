"""Connected components of a graph that is given as an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hemolens.session import cut_lineage


def _nearest(edges: DataFrame, upward: bool) -> DataFrame:
    """One star step: neighbours of `u` on one side of it are tied to the least one around `u`."""
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v"))
    both = both.unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
    if not upward:
        both = both.filter("v < u")
    least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
    moved = both.join(least, "u")
    moved = moved.filter("v > u") if upward else moved
    out = moved.select(F.col("m").alias("a"), F.col("v").alias("b"))
    if not upward:
        out = out.unionByName(least.select(F.col("m").alias("a"), F.col("u").alias("b")))
    return out.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(id, component) for every id in `edges` (a, b): the least id that it is joined to, itself included.

    Star contraction: the two steps alternate until nothing moves, in a number of rounds that
    grows with the logarithm of the graph. Rounds are tables in the shared folder; a node with
    very many neighbours is aggregated before the shuffle and split by the skew join.
    """
    edges = cut_lineage(
        edges.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    )
    mark = lambda e: tuple(e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
    before = mark(edges)
    while before[0]:
        edges = cut_lineage(_nearest(_nearest(edges, True), False))
        now = mark(edges)
        if now == before:
            break
        before = now
    roots = edges.select(F.col("a").alias("id"), F.col("a").alias("component")).distinct()
    return edges.select(F.col("b").alias("id"), F.col("a").alias("component")).unionByName(roots)
