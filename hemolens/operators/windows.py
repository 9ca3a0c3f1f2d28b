"""Ordered operators (W): selections, fills, ranks and cumulative counts.

Top-k per key uses `row_number() <= k`, which Spark cuts to k rows per key before its
shuffle. Whatever needs the whole order of a key goes through `functions.ordered`.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hemolens.functions import ordered


def top_models(df: DataFrame, k: int = 5, run: str = "run_name", score: str = "mean_plddt", rank: str = "rank", name: str = "model") -> DataFrame:
    """Best k models per run: highest score, then lowest rank, then name."""
    w = Window.partitionBy(run).orderBy(F.desc(score), F.asc(rank), F.asc(name))
    return df.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= k)


def select_best_model(df: DataFrame, **names: str) -> DataFrame:
    return top_models(df, 1, **names).drop("place")


def carry_section(df: DataFrame, keys: Sequence[str], order: Sequence[str], header: str, out: str = "section") -> DataFrame:
    """Give every row the last header at or before it."""
    return ordered.fill_forward(ordered.with_order_bucket(df, order[0]), keys, order, header, out)


def renumber_atoms(df: DataFrame, system: str, kind: str, ident: str, out: str = "new_id") -> DataFrame:
    """1..n inside each system: kind 0 (peptide) first, then kind 1 (membrane), each by its old number."""
    span = F.lit(float(1 << 52))
    keyed = df.withColumn("_order", F.col(kind) * span + F.col(ident))
    bucketed = ordered.with_order_bucket(keyed, "_order").drop("_order")
    return ordered.row_numbers(bucketed, [system], [kind, ident], out)


def flip_flops(df: DataFrame, keys: Sequence[str], order: Sequence[str], side: Column) -> DataFrame:
    """Leaflet sign changes per key; rows on the midplane (sign 0) keep the side they came from."""
    signed = df.withColumn("_side", F.signum(side)).filter(F.col("_side") != 0)
    near = ordered.neighbour(ordered.with_order_bucket(signed, order[0]), keys, order, {"_prev": "_side"})
    changed = F.coalesce((F.col("_side") != F.col("_prev")).cast("long"), F.lit(0))
    return near.groupBy(*keys).agg(F.sum(changed).alias("flips"), F.count("*").alias("frames"))


def average_rank(df: DataFrame, value: str, keys: Sequence[str] = (), out: str = "avg_rank") -> DataFrame:
    return ordered.average_rank(df, value, keys, out)


def top_features(df: DataFrame, k: int = 20, score: str = "importance", name: str = "feature") -> DataFrame:
    return df.orderBy(F.desc(score), F.asc(name)).limit(k)


def sorted_ids(df: DataFrame, column: str, suffix: str) -> DataFrame:
    stripped = F.regexp_replace(column, f"{suffix}$", "")
    return df.select(stripped.alias("ident")).orderBy("ident")


def cumulative_counts(df: DataFrame, y: str = "y", p: str = "p", keys: Sequence[str] = ()) -> DataFrame:
    """One row per distinct score, highest first: positives and negatives at it and down to it.

    Columns: keys, score, pos, neg, tp, fp, n_pos, n_neg. The scores are counted before
    anything is ordered, so the ordered pass sees distinct scores only.
    """
    keys = list(keys)
    flipped = df.select(*keys, (-F.col(p)).alias("_s"), F.col(y).cast("long").alias("_y"))
    table = ordered.value_table(flipped, "_s", keys, {"pos": F.col("_y"), "neg": 1 - F.col("_y")})
    sums = [F.sum(F.col(y).cast("long")).alias("n_pos"), F.sum(1 - F.col(y).cast("long")).alias("n_neg")]
    if keys:
        joined = table.join(df.groupBy(*keys).agg(*sums), keys)
    else:
        total = df.agg(F.struct(*sums)).scalar()
        joined = table.withColumns({"n_pos": total["n_pos"], "n_neg": total["n_neg"]})
    return joined.select(
        *keys, (-F.col("_s")).alias("score"), "pos", "neg",
        (F.col("pos_below") + F.col("pos")).alias("tp"), (F.col("neg_below") + F.col("neg")).alias("fp"), "n_pos", "n_neg",
    )


def uncertain_topk(df: DataFrame, fraction: float = 0.1, p: str = "p") -> DataFrame:
    """Rows whose percent rank of |p - 0.5| is within the fraction; ties at the edge all stay."""
    scored = df.withColumn("uncertainty", F.round(F.abs(F.col(p) - 0.5), 12))
    table = ordered.value_table(scored.select("uncertainty"), "uncertainty")
    total = df.agg(F.count("*")).scalar()
    inside = table.filter(F.try_divide(F.col("n_below").cast("double"), (total - 1).cast("double")) <= fraction)
    edge = inside.agg(F.max("uncertainty")).scalar()
    return scored.filter(F.col("uncertainty") <= edge)
