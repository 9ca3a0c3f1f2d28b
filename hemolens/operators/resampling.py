"""Bootstrap of rank statistics (E21): AUC and Spearman's rho, with BCa intervals.

A resample is a table of multiplicities, (replicate, item, times). Rank statistics need, for every
distinct value, how often it was drawn and how often a smaller one was. Up to `replicates.WHOLE` items that is
counted in units of replicates that hold all items (`replicates.in_units`). Beyond, it is a running total over
(replicate, value) rows inside quantile buckets of the values, cut once for all replicates: no
resample is sorted as a whole or gathered in one place, and replicates are dealt over the
partitions before their draws are made, so that draws and multiplicities need no shuffle.

The jackknife of both statistics is closed form in placement values: leaving an item out takes a known
part from every sum. Rho also needs, for each item, how many others exceed it in both values; those
are counted by base-16 digits of the position in one value, with running counts along the other.
"""

from __future__ import annotations

from statistics import NormalDist

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hemolens.functions import draws, ordered
from hemolens.operators import replicates as units
from hemolens.operators.splits import hash_order
from hemolens.session import cut_lineage

TOGETHER = 10_000  # slots that one row is exploded to at once
EQUAL = 1e-12  # closer statistics count as equal


def multiplicities(items: int, replicates: int, spark, seed: str) -> DataFrame:
    """(rep, item, m): `items` draws with replacement from 0..items-1 for each replicate."""
    reps = ordered.spread(spark.range(1, replicates + 1).select(F.col("id").cast("int").alias("rep")), "rep")
    last = F.lit(items - 1).cast("long")
    chunk = reps.select("rep", F.explode(F.sequence(F.lit(0).cast("long"), F.floor(last / TOGETHER))).alias("_c"))
    slots = chunk.select("rep", F.explode(F.sequence(F.col("_c") * TOGETHER, F.least(last, (F.col("_c") + 1) * TOGETHER - 1))).alias("slot"))
    drawn = slots.select("rep", draws.draw_index(items, F.lit(seed), "rep", "slot").alias("item"))
    return drawn.groupBy("rep", "item").agg(F.count("*").alias("m"))


def numbered(df: DataFrame, ident: str, columns: dict[str, str], seed: str) -> DataFrame:
    """(item, columns): items 0..n-1 in the order of their digests, written; rows with a null value are left out."""
    rows = df.select(ident, *[F.col(c).cast("double").alias(n) for n, c in columns.items()]).na.drop(subset=list(columns))
    placed = hash_order(rows, [], ident, seed, "place")
    return cut_lineage(placed.select((F.col("place") - 1).alias("item"), *columns))


def _table(df: DataFrame, value: str, sums: dict[str, Column], keys=("rep",)) -> DataFrame:
    """`ordered.value_table` on buckets that `df` carries as `_b_<value>`."""
    return ordered.value_table(df.withColumnRenamed(f"_b_{value}", ordered.BUCKET), value, list(keys), sums)


def _bucketed(items: DataFrame, *values: str) -> DataFrame:
    for v in values:
        items = ordered.with_order_bucket(items, v).withColumnRenamed(ordered.BUCKET, f"_b_{v}")
    return cut_lineage(items)


def _auc(table: DataFrame, keys: list[str]) -> DataFrame:
    wins = F.sum(F.col("pos") * (F.col("neg_below") + F.col("neg") / 2.0))
    pairs = F.sum("pos").cast("double") * F.sum("neg")
    return table.groupBy(*keys).agg(F.try_divide(wins, pairs).alias("stat"))


def _auc_maker(seed: str):
    def make(table: pa.Table, turns: range) -> dict:
        item, p = units.column(table, "item"), units.column(table, "p")
        values, place = np.unique(p, return_inverse=True)
        kind = np.empty(len(item), np.int64)
        kind[item] = 2 * place + (units.column(table, "y") == 1)
        stats = {}
        for rep, drawn in units.draws_of(seed, turns, len(item)):
            neg, pos = np.bincount(kind[drawn], minlength=2 * len(values)).reshape(-1, 2).T
            pairs = pos.sum() * neg.sum()
            stats[rep] = (pos * (2 * (np.cumsum(neg) - neg) + neg)).sum() / 2 / pairs if pairs else None
        return {"rep": pa.array(list(stats), pa.int32()), "stat": pa.array(list(stats.values()), pa.float64())}

    return make


def auc_replicates(items: DataFrame, replicates: int, seed: str) -> DataFrame:
    """(rep, stat) for `items` (item, y, p); null where a resample has one class only."""
    n = items.count()
    if n <= units.WHOLE:
        return units.in_units(items, replicates, _auc_maker(seed), "rep int, stat double")
    items = _bucketed(items, "p")
    drawn = multiplicities(n, replicates, items.sparkSession, seed).join(items, "item")
    times = {"pos": F.when(F.col("y") == 1, F.col("m")).otherwise(0), "neg": F.when(F.col("y") == 1, 0).otherwise(F.col("m"))}
    return _auc(_table(drawn, "p", times), ["rep"])


def _acceleration(left_out: DataFrame) -> DataFrame:
    """(a): acceleration from leave-one-out values `t` that occur `n` times each; one row."""
    known = left_out.filter(F.col("t").isNotNull() & (F.col("n") > 0))
    mean = known.agg(F.sum(F.col("n") * F.col("t")) / F.sum("n")).scalar()
    d = mean - F.col("t")
    cubes, squares = F.sum(F.col("n") * d * d * d), F.sum(F.col("n") * d * d)
    return known.agg(F.coalesce(F.try_divide(cubes, 6 * F.pow(squares, F.lit(1.5))), F.lit(0.0)).alias("a"))


def auc_jackknife(items: DataFrame) -> tuple[DataFrame, DataFrame]:
    """((stat), (a)) of `items` (item, y, p), from one row per distinct score."""
    one = {"pos": (F.col("y") == 1).cast("long"), "neg": (F.col("y") != 1).cast("long")}
    table = cut_lineage(_table(_bucketed(items, "p"), "p", one, ()))
    total = table.agg(F.sum("pos"), F.sum("neg"), F.sum(F.col("pos") * (F.col("neg_below") + F.col("neg") / 2.0))).first()
    m, n, wins = (float(v or 0) for v in total)
    v10 = F.col("neg_below") + F.col("neg") / 2.0  # wins of a positive
    v01 = m - F.col("pos_below") - F.col("pos") / 2.0  # wins over a negative
    without_pos = F.try_divide(wins - v10, F.lit((m - 1) * n))
    without_neg = F.try_divide(wins - v01, F.lit(m * (n - 1)))
    left = table.select(F.col("pos").alias("n"), without_pos.alias("t")).unionByName(table.select(F.col("neg").alias("n"), without_neg.alias("t")))
    return _auc(table.withColumn("_one", F.lit(1)), ["_one"]).select("stat"), _acceleration(left)


def _rank(table: DataFrame, value: str, out: str, keys=("rep",)) -> DataFrame:
    return table.select(*keys, value, (F.col("m_below") + (F.col("m") + 1) / 2.0).alias(out))


def _rho(ranked: DataFrame, keys: list[str], times: str) -> DataFrame:
    """Weighted correlation of ranks; the mean rank of n draws is (n + 1) / 2."""
    m = F.col(times).cast("double")
    mean = (F.col("_n") + 1) / 2.0
    sums = ranked.groupBy(*keys).agg(
        F.sum(m).alias("_n"), F.sum(m * F.col("rx") * F.col("ry")).alias("_xy"), F.sum(m * F.col("rx") * F.col("rx")).alias("_xx"),
        F.sum(m * F.col("ry") * F.col("ry")).alias("_yy"),
    )
    part = lambda c: F.col(c) - F.col("_n") * mean * mean
    return sums.select(*keys, F.try_divide(part("_xy"), F.sqrt(part("_xx") * part("_yy"))).alias("stat"))


def _spearman_maker(seed: str):
    def make(table: pa.Table, turns: range) -> dict:
        item = units.column(table, "item")
        n, codes = len(item), []
        for v in "xy":
            place = np.empty(n, np.int64)
            place[item] = np.unique(units.column(table, v), return_inverse=True)[1]
            codes.append(place)
        stats = {}
        for rep, drawn in units.draws_of(seed, turns, n):
            ranks, squares = [], []
            for code in codes:
                at = code[drawn]
                times = np.bincount(at)
                rank = np.cumsum(times) - times + (times + 1) / 2.0 - (n + 1) / 2.0  # about their mean
                ranks.append(rank[at])
                squares.append((times * rank * rank).sum())
            down = np.sqrt(squares[0] * squares[1])
            stats[rep] = (ranks[0] * ranks[1]).sum() / down if down else None
        return {"rep": pa.array(list(stats), pa.int32()), "stat": pa.array(list(stats.values()), pa.float64())}

    return make


def spearman_replicates(items: DataFrame, replicates: int, seed: str) -> DataFrame:
    """(rep, stat) for `items` (item, x, y); null where a resample has a single value."""
    n = items.count()
    if n <= units.WHOLE:
        return units.in_units(items, replicates, _spearman_maker(seed), "rep int, stat double")
    items = _bucketed(items, "x", "y")
    drawn = multiplicities(n, replicates, items.sparkSession, seed).join(items, "item")
    drawn = cut_lineage(drawn.select("rep", "m", "x", "y", "_b_x", "_b_y"))
    ranked = drawn
    for v, r in (("x", "rx"), ("y", "ry")):
        ranked = ranked.join(_rank(_table(drawn, v, {"m": F.col("m")}), v, r), ["rep", v])
    return _rho(ranked, ["rep"], "m")


def exceeded(ranked: DataFrame, total: int) -> DataFrame:
    """(item, both): over all items, the sum of H(x_j - x) H(y_j - y), H being 1 above 0, a half at 0 and else 0.

    `ranked`: (item, y, _b_y, pos), `pos` the 0-based place of x among the distinct ones. Two different places
    share a prefix of digits and then differ at one digit, so each pair meets at one level.
    """
    places = max(1, len(f"{max(total, 1):x}"))
    shifted = F.call_function("shiftright", "pos", F.col("_level") * 4)
    levels = ranked.select("item", "y", "_b_y", "pos", F.explode(F.sequence(F.lit(0), F.lit(places - 1))).alias("_level"))
    split = cut_lineage(levels.select("item", "y", "_b_y", "_level", F.shiftright(shifted, 4).alias("_prefix"), (shifted % 16).cast("int").alias("_digit")))
    group, digits = ["_level", "_prefix"], range(16)
    table = _table(split, "y", {f"d{d}": (F.col("_digit") == d).cast("long") for d in digits}, group)
    all_of = split.groupBy(*group).agg(*[F.count(F.when(F.col("_digit") == d, 1)).alias(f"a{d}") for d in digits])
    above = F.array(*[F.col(f"a{d}") - F.col(f"d{d}_below") - F.col(f"d{d}") / 2.0 for d in digits])
    counts = table.join(all_of, group).select(*group, "y", above.alias("_above"))
    hit = F.aggregate(F.slice("_above", F.col("_digit") + 2, F.lit(16)), F.lit(0.0), lambda s, v: s + v)
    greater = split.join(counts, [*group, "y"]).groupBy("item").agg(F.sum(hit).alias("both"))
    same = _table(ranked, "y", {"n": F.lit(1).cast("long")}, ["pos"])
    level = same.join(ranked.groupBy("pos").agg(F.count("*").alias("_t")), "pos").select(
        "pos", "y", ((F.col("_t") - F.col("n_below") - F.col("n") / 2.0) / 2.0).alias("_half")
    )
    return ranked.join(level, ["pos", "y"]).join(greater, "item").select("item", (F.col("both") + F.col("_half")).alias("both"))


def spearman_jackknife(items: DataFrame) -> tuple[DataFrame, DataFrame]:
    """((stat), (a)) of `items` (item, x, y)."""
    items = _bucketed(items, "x", "y")
    n = items.count()
    one = {"m": F.lit(1).cast("long")}
    tx, ty = (_table(items, v, one, ()).withColumnsRenamed({"m": f"t{v}", "m_below": f"_below_{v}"}) for v in "xy")
    places = tx.select("x", "tx", F.col("_below_x").alias("pos"), (F.col("_below_x") + (F.col("tx") + 1) / 2.0).alias("rx"))
    ranked = items.join(places, "x").join(ty.select("y", "ty", (F.col("_below_y") + (F.col("ty") + 1) / 2.0).alias("ry")), "y")
    ranked = cut_lineage(ranked)
    ties = lambda t: t * t * t - t
    row = ranked.agg(
        F.sum(F.col("rx") * F.col("ry")), F.sum((F.col("tx") * F.col("tx") - 1).cast("double")), F.sum((F.col("ty") * F.col("ty") - 1).cast("double"))
    ).first()
    products, ties_x, ties_y = (float(v or 0) for v in row)
    sums = n * (n + 1) / 2.0
    for v, other in (("x", "ry"), ("y", "rx")):  # sum of the other rank over what lies above, ties by half
        table = _table(ranked, v, {"s": F.col(other)}, ()).select(v, (F.lit(sums) - F.col("s_below") - F.col("s") / 2.0).alias(f"_up_{v}"))
        ranked = ranked.join(table, v)
    every = ranked.join(exceeded(ranked.select("item", "y", "_b_y", "pos"), n), "item")
    k = n - 1.0
    mean, whole = (k + 1) / 2.0, k * (k + 1) * (2 * k + 1) / 6.0
    xy = products - F.col("rx") * F.col("ry") - (F.col("_up_x") - F.col("ry") / 2.0) - (F.col("_up_y") - F.col("rx") / 2.0) + F.col("both") - 0.25
    spread = lambda t, s: whole - (s - 3.0 * F.col(t) * (F.col(t) - 1)) / 12.0 - k * mean * mean
    rho = F.try_divide(xy - k * mean * mean, F.sqrt(spread("tx", ties_x) * spread("ty", ties_y)))
    left = every.select(F.lit(1).alias("n"), rho.alias("t"))
    return _rho(ranked.withColumns({"_one": F.lit(1), "m": F.lit(1)}), ["_one"], "m").select("stat"), _acceleration(left)


STATISTICS = {"auc": (("y", "p"), auc_replicates, auc_jackknife), "spearman": (("x", "y"), spearman_replicates, spearman_jackknife)}


def interval(stats: DataFrame, replicates: int, level: float, observed: DataFrame | None = None, acceleration: DataFrame | None = None) -> DataFrame:
    """(resamples, boot_mean, ci_low, ci_high) of (rep, stat): percentile, or BCa with `observed` (stat) and `acceleration` (a).

    Resamples without a statistic are left out; the last step sees at most `replicates` numbers.
    """
    tail = (1 - level) / 2
    row = stats.filter("stat IS NOT NULL")
    if observed is None:
        return row.agg(
            F.count("*").alias("resamples"), F.avg("stat").alias("boot_mean"), F.percentile("stat", F.lit(tail)).alias("ci_low"),
            F.percentile("stat", F.lit(1 - tail)).alias("ci_high"),
        )

    @F.pandas_udf("array<double>")
    def levels(share_below: pd.Series, accel: pd.Series) -> pd.Series:
        norm = NormalDist()

        def pair(b, a):
            z0 = norm.inv_cdf(min(max(b, 0.5 / replicates), 1 - 0.5 / replicates))
            return [norm.cdf(z0 + (z0 + z) / (1 - a * (z0 + z))) for z in (norm.inv_cdf(tail), norm.inv_cdf(1 - tail))]

        return pd.Series([None if pd.isna(b) or pd.isna(a) else pair(b, a) for b, a in zip(share_below, accel)])

    center = observed.agg(F.first("stat")).scalar()
    held = row.agg(
        F.count("*").alias("resamples"), F.avg("stat").alias("boot_mean"), F.array_sort(F.collect_list("stat")).alias("_s"),
        F.avg((F.col("stat") < center - EQUAL).cast("double")).alias("_b"),
    ).withColumn("_q", levels("_b", acceleration.agg(F.first("a")).scalar()))

    def at(q: Column) -> Column:
        pos = q * (F.size("_s") - 1)
        lo = F.floor(pos).cast("int")
        left, right = F.get("_s", lo), F.get("_s", F.least(lo + 1, F.size("_s") - 1))
        return left + (pos - lo) * (right - left)

    return held.select("resamples", "boot_mean", at(F.col("_q")[0]).alias("ci_low"), at(F.col("_q")[1]).alias("ci_high"))


def bootstrap_rank_ci(
    df: DataFrame, ident: str, a: str, b: str, stat: str = "spearman", replicates: int = 10_000, method: str = "bca", level: float = 0.95, seed: str = "boot"
) -> DataFrame:
    """(observed, resamples, boot_mean, ci_low, ci_high) of the AUC (`a`: class 0 or 1, `b`: score) or rho of `a` and `b`.

    One row per item; rows with a null in either column are left out. The statistic is null for fewer than
    two values or one class, and such resamples do not count.
    """
    names, replicate, jackknife = STATISTICS[stat]
    items = numbered(df, ident, dict(zip(names, (a, b))), seed)
    if items.isEmpty():
        return df.sparkSession.createDataFrame([(None, 0, None, None, None)], "observed double, resamples long, boot_mean double, ci_low double, ci_high double")
    stats = cut_lineage(replicate(items, replicates, seed))
    observed, acceleration = jackknife(items)
    observed = cut_lineage(observed)
    out = interval(stats, replicates, level, observed, acceleration) if method == "bca" else interval(stats, replicates, level)
    return observed.select(F.col("stat").alias("observed")).join(out)
