"""Pairs within a distance (J08, J12) as an equi join on grid cells."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hemolens.functions.geometry import AXES, minimum_image

CELL = ("_cx", "_cy", "_cz")
HOT_CELLS = 10_000  # a cell is hot above this fraction of the rows, so there are never more hot cells
FLOOR_ROWS = 5_000


def cells(df: DataFrame, cutoff: float, box: Sequence[float] | None) -> DataFrame:
    cols = {}
    for i, (c, a) in enumerate(zip(CELL, AXES)):
        if box is None:
            cols[c] = F.floor(F.col(a) / cutoff).cast("long")
        else:
            n = max(1, int(box[i] // cutoff))
            cols[c] = F.least(F.floor(F.pmod(F.col(a), F.lit(box[i])) / (box[i] / n)), F.lit(n - 1)).cast("long")
    return df.withColumns(cols)


def around(cutoff: float, box: Sequence[float] | None) -> Column:
    """The up to 27 cells at and around a row's own, each once, wrapped at periodic edges."""
    per_axis = []
    for i, c in enumerate(CELL):
        near = [F.col(c) + F.lit(o).cast("long") for o in (-1, 0, 1)]
        if box is not None:
            n = max(1, int(box[i] // cutoff))
            near = [F.pmod(v, F.lit(n).cast("long")) for v in near]
        per_axis.append(F.array_distinct(F.array(*near)))
    px, py, pz = per_axis

    def cell(x, y, z):
        return F.struct(x.alias(CELL[0]), y.alias(CELL[1]), z.alias(CELL[2]))

    return F.flatten(
        F.flatten(F.transform(px, lambda x: F.transform(py, lambda y: F.transform(pz, lambda z: cell(x, y, z)))))
    )


def crowded(counts: DataFrame, on: list[str], floor: int = FLOOR_ROWS) -> DataFrame:
    """Cells with more than 1/HOT_CELLS of the rows (and `floor`), with the number of slices to cut them into; `counts` has `_n` a cell.

    At most HOT_CELLS rows by construction, which is what makes broadcasting them safe.
    """
    total = counts.agg(F.sum("_n")).scalar()
    share = F.greatest(F.coalesce(total, F.lit(0)) / HOT_CELLS, F.lit(float(floor)))
    return counts.filter(F.col("_n") > share).select(*on, F.ceil(F.col("_n") / share).cast("int").alias("_slices"))


def distance(box: Sequence[float] | None, left: str, right: str) -> Column:
    total = F.lit(0.0)
    for i, a in enumerate(AXES):
        d = minimum_image(F.col(f"{left}{a}") - F.col(f"{right}{a}"), None if box is None else box[i])
        total = total + d * d
    return F.sqrt(total)


def side(df: DataFrame, keys: list[str], ident: str, carry: Sequence[str], p: str) -> DataFrame:
    return df.select(*keys, F.col(ident).alias(f"{p}id"), *[F.col(a).alias(f"{p}{a}") for a in AXES],
                     *[F.col(c).alias(f"{p}{c}") for c in carry], *CELL)


def _cell_join(spread: DataFrame, fixed: DataFrame, keys: list[str]) -> DataFrame:
    """Join on (frame keys, cell); a hot cell's fixed rows are sliced and its spread rows copied to each slice."""
    on = [*keys, *CELL]
    hot = F.broadcast(crowded(fixed.groupBy(*on).agg(F.count("*").alias("_n")), on))
    slices = F.coalesce("_slices", F.lit(1))
    fixed = fixed.join(hot, on, "left").withColumn("_slice", F.pmod(F.xxhash64("b_id"), slices).cast("int")).drop("_slices")
    spread = (
        spread.join(hot, on, "left")
        .withColumn("_slice", F.explode(F.sequence(F.lit(0), slices - 1)))
        .drop("_slices")
    )
    return spread.join(fixed, [*on, "_slice"])


def contacts(
    a: DataFrame, b: DataFrame, cutoff: float, keys: Sequence[str] = (), ident: str = "atom_id",
    box: Sequence[float] | None = None, carry_a: Sequence[str] = (), carry_b: Sequence[str] = (), strict: bool = False,
) -> DataFrame:
    """(keys, a_id, b_id, dist, carried columns) for every a-b pair of a frame within the cutoff.

    `a` should be the smaller side: each of its rows visits the cells around its own.
    """
    keys = list(keys)
    left = side(cells(a, cutoff, box), keys, ident, carry_a, "a_")
    left = left.withColumn("_cell", F.explode(around(cutoff, box))).drop(*CELL).select("*", "_cell.*").drop("_cell")
    right = side(cells(b, cutoff, box), keys, ident, carry_b, "b_")
    dist = distance(box, "a_", "b_")
    keep = F.col("dist") < cutoff if strict else F.col("dist") <= cutoff
    extra = [f"a_{c}" for c in carry_a] + [f"b_{c}" for c in carry_b]
    return _cell_join(left, right, keys).withColumn("dist", dist).filter(keep).select(*keys, "a_id", "b_id", "dist", *extra)


def close_pairs(
    df: DataFrame, cutoff: float, keys: Sequence[str] = (), ident: str = "atom_id",
    box: Sequence[float] | None = None, strict: bool = False,
) -> DataFrame:
    """Every unordered pair of one table within the cutoff, once, as a_id < b_id.

    With open edges a row visits its own cell and half of the 26 around it, so each pair
    of cells meets once and half the copies are shuffled.
    """
    keys = list(keys)
    if box is not None:
        return contacts(df, df, cutoff, keys, ident, box, strict=strict).filter("a_id < b_id")
    placed = cells(df, cutoff, None)
    half = [o for o in product((-1, 0, 1), repeat=3) if o >= (0, 0, 0)]
    steps = F.array(*[F.struct(*[F.lit(v).cast("long").alias(c) for v, c in zip(o, ("i", "j", "k"))]) for o in half])
    left = side(placed, keys, ident, (), "a_").withColumn("_o", F.explode(steps))
    own = ((F.col("_o.i") == 0) & (F.col("_o.j") == 0) & (F.col("_o.k") == 0)).alias("_own")
    moved = [(F.col(c) + F.col(f"_o.{s}")).alias(c) for c, s in zip(CELL, ("i", "j", "k"))]
    left = left.select(*keys, "a_id", *[f"a_{a}" for a in AXES], own, *moved)
    right = side(placed, keys, ident, (), "b_")
    pairs = _cell_join(left, right, keys).filter(~F.col("_own") | (F.col("a_id") < F.col("b_id")))
    pairs = pairs.withColumn("dist", distance(None, "a_", "b_"))
    keep = F.col("dist") < cutoff if strict else F.col("dist") <= cutoff
    return pairs.filter(keep).select(
        *keys, F.least("a_id", "b_id").alias("a_id"), F.greatest("a_id", "b_id").alias("b_id"), "dist"
    )


def spacing_violations(df: DataFrame, min_dist: float, keys: Sequence[str] = (), ident: str = "atom_id",
                       box: Sequence[float] | None = None) -> DataFrame:
    """Pairs closer than the minimum spacing (strictly)."""
    return close_pairs(df, min_dist, keys, ident, box, strict=True)
