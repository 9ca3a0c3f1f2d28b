"""Running totals, neighbours, fills and ranks over groups of any size.

A plain `Window.partitionBy(key)` sends a whole key to one task, so a key that holds a
third of the rows is a third of the work in one place. Here every group is cut into
order buckets first: the window runs inside (key, bucket), and what crosses a bucket
border (a sum, a last row, a last value) comes from a table with one row per
(key, bucket). Buckets are quantiles of the order column over all rows, so no
(key, bucket) group is larger than its bucket's share of the table.

Null keys, like null order and ranked values, are a group of their own: no row is lost.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

BUCKET = "_bucket"


def join_all(left: DataFrame, right: DataFrame, on: Sequence[str], how: str = "inner") -> DataFrame:
    """Equi join in which nulls match nulls; `on` comes from the left side."""
    if not on:
        return left.join(right, how=how)  # one row on the right: the whole table is the group
    renamed = right.withColumnsRenamed({c: f"_on_{i}" for i, c in enumerate(on)})
    match = reduce(lambda a, b: a & b, [F.col(f"_l_{i}").eqNullSafe(F.col(f"_on_{i}")) for i in range(len(on))])
    sides = left.withColumns({f"_l_{i}": F.col(c) for i, c in enumerate(on)})
    return sides.join(renamed, match, how).drop(*[f"{p}{i}" for i in range(len(on)) for p in ("_l_", "_on_")])


def bucket_count(df: DataFrame) -> int:
    return max(2, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def spread(df: DataFrame, *cols: str) -> DataFrame:
    """Deal a small table over all shuffle partitions before its rows are multiplied.

    AQE would leave it in one partition, judging by its size and not by what comes of it.
    """
    return df.repartition(bucket_count(df), *cols)


def with_order_bucket(df: DataFrame, order: str, buckets: int | None = None, tie: str | None = None) -> DataFrame:
    """Add `_bucket`, rising with the numeric column `order`; one pass over that column.

    Only the cut points (one per bucket) reach the driver. Null and NaN share one last bucket.
    A value that fills several buckets is one bucket, unless a numeric column `tie` is given
    that orders equal values: then it is cut along that, in a second pass.
    """
    n = buckets or bucket_count(df)
    number = F.col(order).cast("double") + F.lit(0.0)  # no negative zero, which the bucketizer puts below zero
    shares = [i / n for i in range(1, n)]
    cuts = df.agg(F.percentile_approx(F.when(~F.isnan(number), number), shares, 4 * n)).first()[0] or []
    inner = sorted({c for c in cuts if abs(c) != float("inf")})
    often = {c: cuts.count(c) for c in inner if cuts.count(c) > 1} if tie and isinstance(df.schema[tie].dataType, NumericType) else {}
    splits = [float("-inf"), *inner, float("inf")]
    out = (
        Bucketizer(splits=splits, inputCol="_order", outputCol="_b", handleInvalid="keep")
        .transform(df.withColumn("_order", number))
        .withColumn(BUCKET, F.col("_b").cast("int"))
        .drop("_order", "_b")
    )
    if not often:
        return out
    second = F.col(tie).cast("double")
    parts = [
        F.percentile_approx(F.when(number == c, second), [i / k for i in range(1, k)], 4 * n).alias(f"c{j}")
        for j, (c, k) in enumerate(often.items())
    ]
    within = F.lit(n)  # larger values of the same bucket come after the ties
    for c, inside in zip(often, df.agg(*parts).first()):
        steps = [F.when(second >= x, 1).otherwise(0) for x in sorted(set(inside or []))]
        within = F.when(number == c, reduce(lambda a, b: a + b, steps, F.lit(0))).otherwise(within)
    return out.withColumn(BUCKET, F.col(BUCKET) * (n + 1) + within)


def with_hash_bucket(df: DataFrame, digest: str, hex_digits: int | None = None) -> DataFrame:
    """Add `_bucket` from the leading digits of a hex digest; even by construction, no pass.

    By default enough digits for several buckets per shuffle partition (at most 7).
    """
    hex_digits = hex_digits or min(7, len(f"{bucket_count(df):x}") + 1)
    head = F.conv(F.substring(F.col(digest), 1, hex_digits), 16, 10)
    return df.withColumn(BUCKET, head.cast("int"))


def running_total(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column | str], values: dict[str, Column | str]
) -> DataFrame:
    """Inclusive running sum of each `values` entry (output name -> input) along `order`.

    `df` must carry `_bucket`; it is dropped from the result. Ties in `order` are taken in
    row order, so pass a total order or one row per order value.
    """
    keys = list(keys)
    names = {out: f"_v{i}" for i, out in enumerate(values)}
    prepared = df.withColumns({v: F.col(values[o]) if isinstance(values[o], str) else values[o] for o, v in names.items()})
    inside = Window.partitionBy(*keys, BUCKET).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    across = Window.partitionBy(*keys).orderBy(BUCKET).rowsBetween(Window.unboundedPreceding, -1)
    totals = prepared.groupBy(*keys, BUCKET).agg(*[F.sum(v).alias(f"{v}_t") for v in names.values()])
    before = totals.select(
        *keys, BUCKET, *[F.coalesce(F.sum(f"{v}_t").over(across), F.lit(0)).alias(f"{v}_p") for v in names.values()]
    )
    running = prepared.withColumns({f"{v}_r": F.sum(v).over(inside) for v in names.values()})
    joined = join_all(running, before, [*keys, BUCKET]).withColumns(
        {out: F.col(f"{v}_r") + F.col(f"{v}_p") for out, v in names.items()}
    )
    return joined.drop(BUCKET, *[f"{v}{end}" for v in names.values() for end in ("", "_r", "_p")])


def row_numbers(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str], out: str = "rn") -> DataFrame:
    """1..n inside each key along `order`; `df` must carry `_bucket`."""
    return running_total(df, keys, order, {out: F.lit(1).cast("long")})


def neighbour(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    values: dict[str, str],
    following: bool = False,
) -> DataFrame:
    """Value of the row before (or after) along the total order `order`; `df` carries `_bucket`."""
    keys = list(keys)
    step = F.lead if following else F.lag
    edge = F.min_by if following else F.max_by
    inside = Window.partitionBy(*keys, BUCKET).orderBy(*order)
    across = Window.partitionBy(*keys).orderBy(BUCKET)
    packed = F.struct(*[F.col(src).alias(out) for out, src in values.items()])
    edges = (
        df.groupBy(*keys, BUCKET)
        .agg(edge(packed, F.struct(*order)).alias("_edge"))
        .withColumn("_edge", step("_edge").over(across))
    )
    out = join_all(df.withColumn("_near", step(packed).over(inside)), edges, [*keys, BUCKET])
    near = F.coalesce(F.col("_near"), F.col("_edge"))
    return out.withColumns({o: near[o] for o in values}).drop("_near", "_edge", BUCKET)


def fill_forward(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, out: str) -> DataFrame:
    """Last non-null `value` up to and including each row; `df` carries `_bucket`."""
    keys = list(keys)
    present = F.col(value).isNotNull()
    inside = (
        Window.partitionBy(*keys, BUCKET).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    )
    across = Window.partitionBy(*keys).orderBy(BUCKET).rowsBetween(Window.unboundedPreceding, -1)
    lasts = (
        df.groupBy(*keys, BUCKET)
        .agg(F.max_by(value, F.when(present, F.struct(*order))).alias("_last"))
        .withColumn("_carry", F.last("_last", ignorenulls=True).over(across))
        .drop("_last")
    )
    return (
        join_all(df.withColumn("_here", F.last(value, ignorenulls=True).over(inside)), lasts, [*keys, BUCKET])
        .withColumn(out, F.coalesce("_here", "_carry"))
        .drop("_here", "_carry", BUCKET)
    )


def value_table(
    df: DataFrame, value: str, keys: Sequence[str] = (), sums: dict[str, Column] | None = None
) -> DataFrame:
    """One row per (keys, value): each sum at that value and its total below it.

    Columns: keys, `value`, then `<s>` and `<s>_below` for every entry of `sums`
    (default `n`, the row count). The base for ranks, medians, ROC and PR. A `_bucket`
    that `df` already has along `value` is used as it is.
    """
    keys = list(keys)
    sums = sums or {"n": F.lit(1).cast("long")}
    bucketed = df if BUCKET in df.columns else with_order_bucket(df, value)
    counted = (
        bucketed.groupBy(*keys, BUCKET, value)
        .agg(*[F.sum(c).alias(s) for s, c in sums.items()])
    )
    run = running_total(counted, keys, [value], {f"{s}_upto": s for s in sums})
    return run.withColumns({f"{s}_below": F.col(f"{s}_upto") - F.col(s) for s in sums}).drop(
        *[f"{s}_upto" for s in sums]
    )


def average_rank(df: DataFrame, value: str, keys: Sequence[str] = (), out: str = "avg_rank") -> DataFrame:
    """Add the 1-based rank of `value`; ties share the mean of their positions."""
    ranks = value_table(df, value, keys).select(
        *keys, value, (F.col("n_below") + (F.col("n") + 1) / 2.0).alias(out)
    )
    return join_all(df, ranks, [*keys, value])
