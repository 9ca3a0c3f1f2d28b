"""System layout over the whole design grid (Y)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hemolens.functions.ordered import bucket_count
from hemolens.functions.scalars import orientation_angle, placement_seed
from hemolens.session import cut_lineage

# Positions (nm) of the named peptide counts.
STAGGERED_8 = [(2.5, 2.5), (5.0, 2.5), (7.5, 2.5), (3.5, 5.0), (6.5, 5.0), (2.5, 7.5), (5.0, 7.5), (7.5, 7.5)]
GRID_12 = [2.0, 4.0, 6.0, 8.0]
GRID_16 = (1.5, 8.5, 4)
EDGE = 1.5


def grid_positions(df: DataFrame, n: str = "n", lx: str = "lx", ly: str = "ly") -> DataFrame:
    """Explode each system into its n positions (k from 0, x, y)."""
    k, count = F.col("k"), F.col(n)
    side = F.when(count == 12, 4).when(count == 16, 4).otherwise(F.greatest(F.ceil(F.sqrt(count)).cast("int"), F.lit(1)))
    column, row = k % side, F.floor(k / side).cast("int")

    def spaced(index, length):
        """index-th of `side` points from the edge to max(1.6, length - edge)."""
        last = F.greatest(F.lit(1.6), length - EDGE)
        return EDGE + F.coalesce(F.try_divide(index * (last - EDGE), (side - 1).cast("double")), F.lit(0.0))

    lo, hi, m = GRID_16
    rows8 = F.array(*[F.struct(F.lit(x).alias("x"), F.lit(y).alias("y")) for x, y in STAGGERED_8])
    steps12 = F.array(*[F.lit(v) for v in GRID_12])

    def axis(name, index, length):
        return (
            F.when(count == 1, length / 2.0)
            .when(count == 8, F.get(rows8, k)[name])
            .when(count == 12, F.get(steps12, index))
            .when(count == 16, lo + index * ((hi - lo) / (m - 1)))
            .otherwise(spaced(index, length))
        )

    exploded = df.filter(count > 0).withColumn("k", F.explode(F.sequence(F.lit(0), count.cast("int") - 1)))
    return exploded.withColumns({"x": axis("x", column, F.col(lx)), "y": axis("y", row, F.col(ly))})


def _throw_darts(seed: int, n: int, lx: float, ly: float, min_dist: float, attempts: int) -> tuple[np.ndarray | None, int]:
    """(n points at least `min_dist` apart and off the edges, darts thrown); no points when the attempts run out.

    Darts are drawn in growing batches, alternating x and y; a dart stays in play until an
    accepted one is too near, and the first still in play is the next accepted. The last one
    accepted is the last one that would have been thrown.
    """
    rng = np.random.default_rng(seed)
    span_x, span_y = max(min_dist, lx - min_dist) - min_dist, max(min_dist, ly - min_dist) - min_dist
    near = min_dist * min_dist
    kept: list[tuple[float, float]] = []
    size, left, last = 64, attempts, 0
    while left > 0 and len(kept) < n:
        size = min(4 * size, left)
        number = attempts - left + 1 + np.arange(size)
        left -= size
        throws = rng.random((size, 2))
        x, y = min_dist + span_x * throws[:, 0], min_dist + span_y * throws[:, 1]
        for px, py in kept:
            free = (x - px) ** 2 + (y - py) ** 2 >= near
            x, y, number = x[free], y[free], number[free]
        while len(x) and len(kept) < n:
            kept.append((x[0], y[0]))
            last = int(number[0])
            free = (x - x[0]) ** 2 + (y - y[0]) ** 2 >= near
            x, y, number = x[free], y[free], number[free]
    return (np.array(kept), last) if len(kept) == n else (None, attempts)


def _tilt_after(seed: int, darts: int) -> float:
    """One of 0, 45 and 90 from the system's generator, once it has made two draws for each dart."""
    bits = np.random.default_rng(seed).bit_generator
    bits.advance(2 * darts)
    return float(np.random.Generator(bits).choice([0.0, 45.0, 90.0]))


def drawn_tilt(seed: Column, darts: Column) -> Column:
    """The random tilt of a system with this seed after so many darts; without darts (grids) it is the first draw."""

    @F.pandas_udf("double")
    def draw(seeds: pd.Series, thrown: pd.Series) -> pd.Series:
        return pd.Series([_tilt_after(int(s), int(d)) for s, d in zip(seeds, thrown)])

    return draw(seed, darts)


def poisson_positions(
    df: DataFrame, min_dist: float = 1.5, attempts: int = 10_000, n: str = "n", orientation: str = "orientation"
) -> DataFrame:
    """Poisson-disk positions and tilt from each system's `seed`; the grid where the disks do not fit.

    `df` has one row per system (with `seed`, n, lx, ly, orientation). The darts follow from all of these but the orientation:
    they are thrown once for systems that are alike in them, spread over all cores, and joined back. A
    tilt that is not named is the generator's next choice after the darts, also where all of them failed.
    """
    wanted = df.filter(F.col(n) > 0)
    alike = ["seed", n, "lx", "ly"]
    throws = wanted.select(*alike).distinct()
    schema = T.StructType(
        [*throws.schema.fields, T.StructField("darts", T.ArrayType(T.ArrayType(T.DoubleType()))), T.StructField("thrown", T.LongType())]
    )

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            made = [_throw_darts(int(r.seed), int(getattr(r, n)), r.lx, r.ly, min_dist, attempts) for r in pdf.itertuples()]
            yield pdf.assign(darts=[None if d is None else d.tolist() for d, _ in made], thrown=[t for _, t in made])

    thrown = throws.repartition(bucket_count(df), *alike).mapInPandas(run, schema)
    drawn = cut_lineage(thrown.withColumn("_drawn", drawn_tilt(F.col("seed"), F.col("thrown"))).drop("thrown"))
    tilted = wanted.join(drawn, alike).withColumn("tilt", orientation_angle(F.col(orientation), drawn=F.col("_drawn")))
    placed = grid_positions(tilted, n)
    dart = F.get("darts", F.col("k"))
    return placed.withColumns(
        {
            "fallback": F.col("darts").isNull(),
            "x": F.coalesce(dart[0], F.col("x")),
            "y": F.coalesce(dart[1], F.col("y")),
        }
    ).drop("darts", "_drawn")


def with_placement(df: DataFrame, peptide: str, n: str, label: str, replicate: str, orientation: str) -> DataFrame:
    """Seed of each system, and the tilt it has on a grid, where no dart is thrown before it is drawn."""
    seed = placement_seed(F.col(peptide), F.col(n), F.col(label), F.col(replicate))
    seeded = df.withColumn("seed", seed)
    return seeded.withColumn("tilt", orientation_angle(F.col(orientation), drawn=drawn_tilt(F.col("seed"), F.lit(0))))


def system_molecules(comp: DataFrame, counts: DataFrame, system: str = "file") -> DataFrame:
    """Molecule list per system: the peptide row first (order 0), then the membrane rows in their order.

    `comp` has (system, molecule, n, line_no); `counts` has (system, molecule, n).
    """
    first = counts.select(system, F.lit(0).alias("line_no"), "molecule", "n", F.lit(True).alias("is_peptide"))
    rest = comp.select(system, "line_no", "molecule", "n", F.lit(False).alias("is_peptide"))
    return first.unionByName(rest)
