"""Aggregations (A) and the label normalisations built on them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hemolens.functions.ordered import BUCKET, join_all, with_order_bucket
from hemolens.functions.sequence import seq_hash

SOLVENT = ("W", "NA", "CL")


def pct_composition(comp: DataFrame, exclude: Sequence[str] = SOLVENT) -> DataFrame:
    """Percent of each molecule among the lipids of its file; excluded kinds get null."""
    lipid = ~F.col("molecule").isin(*exclude)
    totals = comp.filter(lipid).groupBy("file").agg(F.sum("n").alias("_t"))
    pct = F.when(lipid, F.try_divide(100.0 * F.col("n"), F.col("_t").cast("double")))
    return comp.join(totals, "file", "left").withColumn("pct", pct).drop("_t")


def normalize_assay(df: DataFrame, factors: DataFrame, on: str) -> DataFrame:
    """Scale HC50 by its assay's factor; an assay without one keeps its value."""
    scaled = F.col("hc50_um") * F.coalesce("factor", F.lit(1.0))
    return df.join(factors, on, "left").withColumn("hc50_norm", scaled).drop("factor")


def mean_plddt(scores: Column | str) -> Column:
    """Mean of a score list; a missing or empty list is 0."""
    s = F.col(scores) if isinstance(scores, str) else scores
    total = F.aggregate(s, F.lit(0.0), lambda a, v: a + v.cast("double"))
    return F.coalesce(F.try_divide(total, F.size(s).cast("double")), F.lit(0.0))


def sum_composition(df: DataFrame, keys: Sequence[str] = ("file", "molecule"), n: str = "n") -> DataFrame:
    return df.groupBy(*keys).agg(F.sum(n).alias("n"))


def bounding_box(df: DataFrame, key: Sequence[str]) -> DataFrame:
    extent = [(F.max(a) - F.min(a)).alias(f"d{a}") for a in "xyz"]
    return df.groupBy(*key).agg(*extent, *[F.avg(a).alias(f"c{a}") for a in "xyz"])


def membrane_top(df: DataFrame, key: Sequence[str], selected: Column, default: float = 8.5) -> DataFrame:
    """Mean z of the selected head beads per system, or the default where none is selected."""
    top = F.coalesce(F.avg(F.when(selected, F.col("z"))), F.lit(default))
    return df.groupBy(*key).agg(top.alias("top_z"))


def aggregate_replicates(df: DataFrame, occupancies: Sequence[str], value: str = "value") -> DataFrame:
    """One row per peptide: mean and sample sd per occupancy, as `<occupancy>_mean`, `<occupancy>_sd`."""
    return (
        df.groupBy("peptide_id")
        .pivot("occupancy", list(occupancies))
        .agg(F.avg(value).alias("mean"), F.stddev_samp(value).alias("sd"))
    )


def ivw_pool(df: DataFrame, keys: Sequence[str], value: str = "value", se: str = "se") -> DataFrame:
    """Inverse-variance mean and its error; rows without a positive error are left out."""
    w = 1.0 / (F.col(se) * F.col(se))
    usable = df.filter((F.col(se) > 0) & F.col(value).isNotNull())
    return usable.groupBy(*keys).agg(
        (F.sum(w * F.col(value)) / F.sum(w)).alias("pooled"), F.sqrt(1.0 / F.sum(w)).alias("pooled_se")
    )


def median_pool(df: DataFrame, keys: Sequence[str], value: str = "value", out: str = "median") -> DataFrame:
    """Exact median per key.

    Counts per (key, value bucket) show which bucket holds a key's middle; only those rows
    are ordered, so no group is gathered and most rows are never shuffled.
    """
    keys = list(keys)
    present = with_order_bucket(df.filter(F.col(value).isNotNull()).select(*keys, value), value)
    whole = Window.partitionBy(*keys)
    sizes = present.groupBy(*keys, BUCKET).agg(F.count("*").alias("_c"))
    sizes = sizes.withColumns(
        {
            "_n": F.sum("_c").over(whole),
            "_below": F.sum("_c").over(whole.orderBy(BUCKET).rowsBetween(Window.unboundedPreceding, 0)) - F.col("_c"),
        }
    )
    spots = F.array(F.floor((F.col("_n") + 1) / 2), F.floor((F.col("_n") + 2) / 2))
    held = sizes.withColumn("_spots", F.transform(spots, lambda s: s - F.col("_below"))).filter(
        F.exists("_spots", lambda s: (s >= 1) & (s <= F.col("_c")))
    )
    counted = present.join(held.select(*keys, BUCKET, "_spots"), [*keys, BUCKET]).groupBy(*keys, BUCKET, "_spots", value).agg(
        F.count("*").alias("_k")
    )
    inside = Window.partitionBy(*keys, BUCKET).orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    ranked = counted.withColumn("_upto", F.sum("_k").over(inside))
    covers = lambda s: (s > F.col("_upto") - F.col("_k")) & (s <= F.col("_upto"))
    weight = F.size(F.filter("_spots", covers))
    return ranked.groupBy(*keys).agg((F.sum(weight * F.col(value)) / 2.0).alias(out))


def completeness(df: DataFrame) -> DataFrame:
    """One row: non-null share of every column."""
    return df.agg(*[F.avg(F.col(c).isNotNull().cast("double")).alias(c) for c in df.columns])


def zscore_outliers(df: DataFrame, keys: Sequence[str], value: str = "value", limit: float = 3.0) -> DataFrame:
    """Rows further than `limit` sample sds from their group's mean."""
    stats = df.groupBy(*keys).agg(F.avg(value).alias("_m"), F.stddev_samp(value).alias("_s"))
    z = F.try_divide(F.col(value) - F.col("_m"), F.col("_s"))
    return join_all(df, stats, list(keys)).withColumn("zscore", z).drop("_m", "_s").filter(F.abs("zscore") > limit)


def disparate_impact(df: DataFrame, group: str, favourable: Column, tolerance: float = 0.1) -> DataFrame:
    """One row: lowest over highest favourable rate, flagged when it misses 1 by more than the tolerance."""
    rates = df.groupBy(group).agg(F.avg(favourable.cast("double")).alias("rate"))
    ratio = F.try_divide(F.min("rate"), F.max("rate"))
    return rates.agg(ratio.alias("ratio"), (F.abs(1 - ratio) > tolerance).alias("flagged"))


def group_balance(df: DataFrame, arm: str, first: str, second: str, covs: Sequence[str]) -> DataFrame:
    """Standardised mean difference of each covariate between two arms, in one pass."""

    def of(fn, cov, which):
        return fn(F.when(F.col(arm) == which, F.col(cov)))

    sides = []
    for c in covs:
        pooled = F.sqrt((of(F.var_samp, c, first) + of(F.var_samp, c, second)) / 2)
        diff = of(F.avg, c, first) - of(F.avg, c, second)
        sides.append(F.struct(F.lit(c).alias("covariate"), F.try_divide(diff, pooled).alias("smd")))
    wide = df.agg(F.array(*sides).alias("_s")).select(F.inline("_s"))
    return wide.withColumn("balanced", F.abs("smd") <= 1)


def class_weights(df: DataFrame, y: str) -> DataFrame:
    """n / (k * n_c) for every class c of k."""
    counts = df.groupBy(y).agg(F.count("*").alias("n_class"))
    whole = counts.agg(F.struct(F.sum("n_class").alias("n"), F.count("*").alias("k"))).scalar()
    return counts.select(y, "n_class", (whole["n"] / (whole["k"] * F.col("n_class"))).alias("weight"))


def next_run_number(df: DataFrame, keys: Sequence[str], number: str) -> DataFrame:
    """Largest parsed number + 1; 1 where no name had a number."""
    return df.groupBy(*keys).agg((F.coalesce(F.max(number), F.lit(0)) + 1).alias("next_run"))


def peptide_lipid_ratio(comp: DataFrame, levels: dict[str, int], exclude: Sequence[str] = SOLVENT) -> DataFrame:
    """Lipids per peptide for each occupancy level of each file."""
    lipids = comp.groupBy("file").agg(
        F.coalesce(F.sum(F.when(~F.col("molecule").isin(*exclude), F.col("n"))), F.lit(0)).alias("lipids")
    )
    rows = F.array(*[F.struct(F.lit(k).alias("level"), F.lit(v).alias("n_peptides")) for k, v in levels.items()])
    return lipids.select("file", "lipids", F.inline(rows)).withColumn("ratio", F.col("lipids") / F.col("n_peptides"))


def status_counts(df: DataFrame, key: str, statuses: Sequence[str], status: str = "status") -> DataFrame:
    counted = [F.count(F.when(F.col(status) == s, 1)).alias(s) for s in statuses]
    return df.groupBy(key).agg(*counted)


def dedupe_sequences(df: DataFrame, ident: str = "peptide_id", seq: str = "sequence", source: str = "source") -> DataFrame:
    """One row per sequence hash: the row with the lowest id, with the sources of all its copies.

    Ids may repeat, within a source and across sources: rows are told apart by their hash, and
    equal ids of one sequence by their other columns. Copies are merged before the shuffle.
    """
    carried = [c for c in df.columns if c not in (ident, source)]
    kept = df.groupBy(seq_hash(F.col(seq)).alias("seq_hash")).agg(
        F.min(F.struct(ident, *carried)).alias("_row"), F.count("*").alias("copies"),
        F.array_sort(F.collect_set(source)).alias("sources"),
    )
    return kept.select("_row.*", "seq_hash", "copies", "sources")


def fold_stability(df: DataFrame, keys: Sequence[str], metric: str) -> DataFrame:
    mean, sd = F.avg(metric), F.stddev_samp(metric)
    return df.groupBy(*keys).agg(mean.alias("mean"), sd.alias("sd"), F.try_divide(sd, mean).alias("cv"))
