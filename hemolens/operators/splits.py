"""Splits, folds and bins (E01-E05): every row is placed by an md5 order, so a split can be repeated.

The order inside a stratum is cut by the leading hex digits of the digest, which are even
by construction; a stratum of any size is numbered without gathering it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hemolens.functions import draws, ordered
from hemolens.operators.nearest import nearest_neighbours
from hemolens.session import cut_lineage


def hash_order(df: DataFrame, keys: Sequence[str], ident: str, seed: int | str, out: str = "place") -> DataFrame:
    """Add 1..n inside each key in the order of md5(seed | id)."""
    hashed = ordered.with_hash_bucket(df.withColumn("_h", draws.hash_text(F.lit(str(seed)), ident)), "_h")
    return ordered.row_numbers(hashed, keys, ["_h", ident], out).drop("_h")


def stratified_split(df: DataFrame, strata: str, ident: str, parts: dict[str, float] | None = None, seed: int = 42) -> DataFrame:
    """Add `split`; each stratum is cut at the rounded cumulative shares, so parts are exact per stratum."""
    parts = parts or {"train": 0.70, "val": 0.15, "test": 0.15}
    sizes = df.groupBy(strata).agg(F.count("*").alias("_n"))
    placed = ordered.join_all(hash_order(df, [strata], ident, seed), sizes, [strata])
    split, upto, names = None, 0.0, list(parts)
    for name in names[:-1]:
        upto += parts[name]
        inside = F.col("place") <= F.round(F.col("_n") * upto)
        split = F.when(inside, name) if split is None else split.when(inside, name)
    last = F.lit(names[-1]) if split is None else split.otherwise(names[-1])
    return placed.withColumn("split", last).drop("place", "_n")


def stratified_folds(df: DataFrame, strata: str, ident: str, k: int = 5, inner: int | None = None, seed: int = 42) -> DataFrame:
    """Add `fold` 0..k-1 per class; with `inner`, the fold of the nested split for the rows it would train on."""
    placed = hash_order(df, [strata], ident, seed)
    at = F.col("place") - 1
    out = placed.withColumn("fold", (at % k).cast("int"))
    if inner:
        out = out.withColumn("inner_fold", (F.floor(at / k) % inner).cast("int"))
    return out.drop("place")


def leave_one_group_out(df: DataFrame, group: str) -> DataFrame:
    """Add `fold`: groups numbered from 1 in the order of their md5; only the distinct groups are ordered."""
    groups = hash_order(df.select(group).distinct(), [], group, "group", "fold")
    return ordered.join_all(df, groups, [group])


def hc50_bins(df: DataFrame, q: int, value: str = "hc50_um", ident: str = "peptide_id") -> DataFrame:
    """Add `bin` 1..q of near-equal size along the value (ties by id), larger bins first."""
    placed = ordered.row_numbers(ordered.with_order_bucket(df, value, tie=ident), [], [value, ident], "_i")
    n = df.agg(F.count("*")).scalar()
    small, extra = F.floor(n / q), n % q
    head = extra * (small + 1)
    at = F.col("_i") - 1
    late = extra + F.floor(F.try_divide((at - head).cast("double"), small.cast("double")))
    number = F.when(at < head, F.floor(at / (small + 1))).otherwise(late)
    return placed.withColumn("bin", (number + 1).cast("int")).drop("_i")


def smote(
    minority: DataFrame, k: int, ratio: int, ident: str = "atom_id", vector: str = "x", seed: str = "smote", **search
) -> DataFrame:
    """(a_id, b_id, copy, x): `ratio` synthetic vectors per distinct minority vector, on the segments to its `k` nearest ones.

    Neighbours are exact and over all entries of the vectors (`nearest_neighbours`, which also
    says what becomes of nulls and equal vectors); a single vector has none and makes nothing.
    """
    near = cut_lineage(nearest_neighbours(minority, k, ident, vector, **search))
    degree = near.groupBy("a_id").agg(F.count("*").alias("_k"))
    wanted = degree.withColumn("copy", F.explode(F.sequence(F.lit(1), F.lit(ratio)))).withColumns(
        {
            "place": (draws.draw_index(F.col("_k"), F.lit(seed), "a_id", "copy", F.lit("pick")) + 1).cast("int"),
            "_u": draws.draw_unit(F.lit(seed), "a_id", "copy", F.lit("gap")),
        }
    )
    chosen = wanted.join(near.select("a_id", "place", "b_id"), ["a_id", "place"])
    a = minority.select(F.col(ident).alias("a_id"), F.col(vector).alias("_a"))
    b = minority.select(F.col(ident).alias("b_id"), F.col(vector).alias("_b"))
    joined = chosen.join(a, "a_id").join(b, "b_id")
    between = F.zip_with("_a", "_b", lambda p, q: p + F.col("_u") * (q - p))
    return joined.select("a_id", "b_id", "copy", between.alias("x"))
