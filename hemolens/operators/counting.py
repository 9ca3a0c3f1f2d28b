"""Contacts counted without forming them: how many points lie within a cutoff, and how near the nearest is.

Cells a cutoff wide deal the work, as in `neighbours`. Inside a cell the points of both sides are blocks
along a space-filling curve, each with its bounds. Two blocks that are wholly within the cutoff are
counted by their sizes and two wholly beyond it are left out; only what the cutoff parts is opened, down to
points. So the work follows the sphere's surface and not its volume, and nothing but one row a
point and cell leaves a task.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hemolens.functions.geometry import AXES
from hemolens.functions.ordered import bucket_count
from hemolens.operators.neighbours import CELL, around, cells, crowded, side

FAN = 8
LEAF = 64
LEAVES = 64  # measured against a block of visitors at once
TOGETHER = 16  # blocks of visitors that go down the levels together
CURVE_BITS = 20
VISITORS = 20_000  # rows of a cell that are looked up in one task
POINTS = 500_000  # rows of a cell that are held in one task


def curve_order(xyz: np.ndarray) -> np.ndarray:
    """Order of the points (columns) along a Morton curve over their bounds."""
    low = xyz.min(axis=1, keepdims=True)
    span = np.maximum(xyz.max(axis=1, keepdims=True) - low, np.finfo(float).tiny)
    steps = np.minimum((xyz - low) / span * (1 << CURVE_BITS), (1 << CURVE_BITS) - 1).astype(np.uint64)
    code = np.zeros(xyz.shape[1], np.uint64)
    for bit in range(CURVE_BITS):
        for axis in range(3):
            code |= ((steps[axis] >> np.uint64(bit)) & np.uint64(1)) << np.uint64(3 * bit + axis)
    return np.argsort(code, kind="stable")


def folded(xyz: np.ndarray, box: Sequence[float] | None) -> np.ndarray:
    return xyz if box is None else np.mod(xyz, np.array(box)[:, None])


class Blocks:
    """Points in blocks of `LEAF`, blocks in blocks of `FAN`, and so on up to at most `FAN` at the top."""

    def __init__(self, xyz: np.ndarray, box: Sequence[float] | None):
        order = curve_order(folded(xyz, box))
        full = -(-len(order) // LEAF) * LEAF
        self.raw = np.full((3, full), np.nan)  # what fills the last block is near to nothing
        self.raw[:, : len(order)] = xyz[:, order]
        place = folded(self.raw, box)
        low = high = place[:, : len(order)]
        self.origin = (low.min(axis=1) + high.max(axis=1))[:, None] / 2
        self.place = place - self.origin
        squares = (self.place * self.place).sum(axis=0)
        self.terms = np.vstack((self.place, np.ones(full), squares)).reshape(5, -1, LEAF)  # of a squared distance
        sizes = np.ones(len(order), np.int64)
        self.levels = []  # (middle, half width, points) of the blocks, finest first
        while not self.levels or len(sizes) > FAN:
            starts = np.arange(0, len(sizes), FAN if self.levels else LEAF)
            low, high = np.minimum.reduceat(low, starts, axis=1), np.maximum.reduceat(high, starts, axis=1)
            sizes = np.add.reduceat(sizes, starts)
            self.levels.append(((low + high) / 2, (high - low) / 2, sizes))


def bounds(one: tuple, i: np.ndarray, other: tuple, j: np.ndarray, box: Sequence[float] | None) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest distance between points of the blocks `i` of one side and `j` of the other."""
    least, most = np.zeros(len(i)), np.zeros(len(i))
    for axis in range(3):
        gap, wide = np.abs(one[0][axis].take(i) - other[0][axis].take(j)), one[1][axis].take(i) + other[1][axis].take(j)
        if box is not None:
            gap = np.minimum(gap, np.abs(box[axis] - gap))
        far = gap + wide if box is None else np.minimum(gap + wide, box[axis] / 2)
        near = np.maximum(gap - wide, 0.0)
        least += near * near
        most += far * far
    return np.sqrt(least), np.sqrt(most)


def distances(a: np.ndarray, b: np.ndarray, box: Sequence[float] | None) -> np.ndarray:
    """Distances of points (3, ..), to the last bit as `neighbours` has them."""
    total = 0.0
    for axis in range(3):
        delta = a[axis] - b[axis]
        if box is not None:
            delta = delta - box[axis] * np.rint(delta / box[axis])
        total = total + delta * delta
    return np.sqrt(total)


def count_near(
    visitors: np.ndarray, points: np.ndarray, cutoff: float, box: Sequence[float] | None = None, strict: bool = False
) -> tuple[np.ndarray, np.ndarray]:
    """(count, nearest) of `points` within the cutoff of each of `visitors`, both (3, n); nearest is infinite without any.

    Blocks of visitors meet blocks of points. Between two that the cutoff parts, squared distances come from one
    matrix product about the visitors' middle; those that rounding could put on either side, and the
    nearest, are measured again by `distances`.
    """
    n, nearest = np.zeros(visitors.shape[1], np.int64), np.full(visitors.shape[1], np.inf)
    if not visitors.shape[1] or not points.shape[1]:
        return n, nearest
    held, guests = Blocks(points, box), Blocks(visitors, box)
    order = curve_order(folded(visitors, box))
    middle, half, _ = guest_level = guests.levels[0]
    top = len(held.levels) - 1
    largest = max(np.abs(visitors).max(), np.abs(points).max(), *(box or (0.0,)))
    slack = 1e-12 * (cutoff + largest)  # bounds are rounded, and so are folded coordinates

    def meetings(block: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(visitors' block, leaf, counted, closest): the leaves to open for the count, for the nearest, or for both."""
        roots = len(held.levels[top][2])
        who, at = np.repeat(block, roots), np.tile(np.arange(roots), len(block))
        counted = np.zeros(len(who), bool)
        for level in range(top, -1, -1):
            least, most = bounds(guest_level, who, held.levels[level], at, box)
            whole = ~counted & (most < cutoff - slack)
            np.add.at(inside, who[whole], held.levels[level][2][at[whole]])
            bound = np.full(len(middle[0]), np.inf)
            np.minimum.at(bound, who, most)
            counted |= whole
            closest = least <= bound[who] + slack
            go = (least <= cutoff + slack) & (~counted | closest)
            who, at, counted, closest = who[go], at[go], counted[go], closest[go]
            if level:
                child = (at[:, None] * FAN + np.arange(FAN)).ravel()
                there = child < len(held.levels[level - 1][2])
                who, at, counted = np.repeat(who, FAN)[there], child[there], np.repeat(counted, FAN)[there]
        return who, at, counted, closest

    def near(d: np.ndarray) -> np.ndarray:
        return d < cutoff if strict else d <= cutoff

    def measure(k: int, leaves: np.ndarray, counted: np.ndarray, closest: np.ndarray) -> None:
        mine = order[k * LEAF : (k + 1) * LEAF]
        own = guests.raw[:, k * LEAF : k * LEAF + len(mine)]
        place = guests.place[:, k * LEAF : k * LEAF + len(mine)] + (guests.origin - held.origin)
        reach = half[:, k] + held.levels[0][1][:, leaves].max(axis=1) + cutoff + 4 * slack
        if box is not None and (reach >= sides[:, 0] / 2).any():  # more than one image of a leaf may be near
            theirs = held.raw.reshape(3, -1, LEAF)[:, leaves].reshape(3, -1)
            d = distances(own[:, :, None], theirs[:, None, :], box)
            there = near(d)
            n[mine] += np.count_nonzero(there & np.repeat(~counted, LEAF), axis=1)
            nearest[mine] = np.minimum(nearest[mine], np.where(there, d, np.inf).min(axis=1))
            return
        if box is None:
            return compare(mine, own, place, leaves, counted, closest)
        images = np.rint((middle[:, k : k + 1] - held.levels[0][0][:, leaves]) / sides)
        kinds, which = np.unique(images, axis=1, return_inverse=True)
        for i in range(kinds.shape[1]):
            some = which.ravel() == i
            compare(mine, own, place - sides * kinds[:, i : i + 1], leaves[some], counted[some], closest[some])

    def compare(mine: np.ndarray, own: np.ndarray, place: np.ndarray, leaves: np.ndarray, counted: np.ndarray, closest: np.ndarray) -> None:
        turn = np.lexsort((closest, counted))  # those to count, then the others; the nearest may be in the last of the first and in the others
        leaves, counted, closest = leaves[turn], counted[turn], closest[turn]
        new = LEAF * int(np.count_nonzero(~counted))
        square = np.vstack((-2 * place, (place * place).sum(axis=0), np.ones(len(mine)))).T @ held.terms[:, leaves].reshape(5, -1)
        doubt = 8 * slack * (cutoff + slack) + 1e-14 * (float(np.abs(place).max() + cutoff) ** 2 + spread)
        sure, maybe = square[:, :new] < cutoff * cutoff - doubt, square[:, :new] <= cutoff * cutoff + doubt
        n[mine] += [np.count_nonzero(row) for row in sure]
        if np.count_nonzero(maybe) > np.count_nonzero(sure):
            i, j = np.nonzero(maybe & ~sure)
            np.add.at(n, mine[i], near(exact(own, leaves, i, j)))
        picked = np.flatnonzero(closest)
        if len(picked):
            square = square[:, picked[0] * LEAF : (picked[-1] + 1) * LEAF]  # they lie together
            least = np.fmin.reduce(square, axis=1)
            flat = np.flatnonzero(square <= (np.minimum(least, cutoff * cutoff) + doubt)[:, None])
            i, j = np.divmod(flat, square.shape[1])
            d = exact(own, leaves[picked[0] :], i, j)
            np.minimum.at(nearest, mine[i[near(d)]], d[near(d)])

    def exact(own: np.ndarray, leaves: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        return distances(own[:, i], held.raw[:, leaves[j // LEAF] * LEAF + j % LEAF], box)

    sides = None if box is None else np.array(box)[:, None]
    spread = 4 * float(np.nanmax(held.terms[4]))
    inside = np.zeros(len(middle[0]), np.int64)
    for k in range(0, len(inside), TOGETHER):
        who, leaves, counted, closest = meetings(np.arange(k, min(k + TOGETHER, len(inside))))
        by = np.argsort(who, kind="stable")
        edges = np.searchsorted(who[by], np.arange(k, min(k + TOGETHER, len(inside)) + 1))
        for i in range(len(edges) - 1):
            for first in range(edges[i], edges[i + 1], LEAVES):
                some = by[first : min(first + LEAVES, edges[i + 1])]
                measure(k + i, leaves[some], counted[some], closest[some])
    n[order] += np.repeat(inside, LEAF)[: len(order)]
    return n, nearest


def known(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows that can have a contact: keys are there and coordinates are finite."""
    there: Column = F.lit(True)
    for c in keys:
        there = there & F.col(c).isNotNull()
    for a in AXES:
        there = there & (F.abs(F.col(a).cast("double")) < float("inf"))
    return df.filter(there)


def _sliced(df: DataFrame, hot_cells: DataFrame, on: list[str], own: str, other: str, ident: str) -> DataFrame:
    """`df` with its own slice by id, and a copy for every slice of the other side."""
    cut = df.join(hot_cells, on, "left").withColumns({c: F.coalesce(c, F.lit(1)) for c in (own, other)})
    return cut.withColumns({own: F.pmod(F.xxhash64(ident), F.col(own)).cast("int"), other: F.explode(F.sequence(F.lit(0), F.col(other) - 1))})


def count_contacts(
    a: DataFrame, b: DataFrame, cutoff: float, keys: Sequence[str] = (), ident: str = "atom_id",
    box: Sequence[float] | None = None, by: str | None = None, strict: bool = False,
) -> DataFrame:
    """(keys, a_id, by, n, nearest): for each row of `a` with a contact, their number among `b` and the least distance.

    The same pairs as `neighbours.contacts`, counted, apart for each value of `by` (a column of `b`). A cell
    with many rows is cut into slices on either side, so no task holds more than a bounded part of it.
    """
    keys = list(keys)
    on = [*keys, *CELL]
    left = side(cells(known(a, keys), cutoff, box), keys, ident, (), "a_")
    visits = left.groupBy(*on).agg(F.count("*").alias("_n")).withColumn("_cell", F.explode(around(cutoff, box)))
    visits = visits.drop(*CELL).select("*", "_cell.*").groupBy(*on).agg(F.sum("_n").alias("_n"))
    left = left.withColumn("_cell", F.explode(around(cutoff, box))).drop(*CELL).select("*", "_cell.*").drop("_cell")
    right = side(cells(known(b, keys), cutoff, box), keys, ident, [by] if by else (), "b_")
    many = crowded(visits, on, VISITORS).withColumnRenamed("_slices", "_mine")
    held = crowded(right.groupBy(*on).agg(F.count("*").alias("_n")), on, POINTS).withColumnRenamed("_slices", "_theirs")
    slices = F.broadcast(many.join(held, on, "full"))  # at most HOT_CELLS cells a side
    parts = bucket_count(a)
    group = [*on, "_mine", "_theirs"]
    left = _sliced(left, slices, on, "_mine", "_theirs", "a_id").repartition(parts, *group)
    right = _sliced(right, slices, on, "_theirs", "_mine", "b_id").repartition(parts, *group)
    kind = f"b_{by}" if by else None
    schema = left.select(*keys, "a_id").schema
    if by:
        schema = schema.add(by, right.schema[kind].dataType)
    schema = schema.add("n", "long").add("nearest", "double")

    def run(mine: pa.Table, theirs: pa.Table) -> pa.Table:
        from pyspark.sql.pandas.types import to_arrow_schema

        def xyz(table: pa.Table, p: str) -> np.ndarray:
            return np.array([table.column(f"{p}{x}").to_numpy().astype(float) for x in AXES]).reshape(3, -1)

        out, target = [], to_arrow_schema(schema)
        if mine.num_rows and theirs.num_rows:
            at, points = xyz(mine, "a_"), xyz(theirs, "b_")
            names = theirs.column(kind).combine_chunks().dictionary_encode("encode") if by else None
            codes = names.indices.to_numpy(zero_copy_only=False) if by else np.zeros(theirs.num_rows, np.int32)
            for code in np.unique(codes):
                n, nearest = count_near(at, points[:, codes == code], cutoff, box, strict)
                some = np.flatnonzero(n)
                found = mine.select([*keys, "a_id"]).take(pa.array(some))
                if by:
                    found = found.append_column(by, names.dictionary.take(pa.array(np.full(len(some), code))))
                found = found.append_column("n", pa.array(n[some])).append_column("nearest", pa.array(nearest[some]))
                out.append(found.cast(target))
        return pa.concat_tables(out) if out else target.empty_table()

    theirs = [f"_of_{c}" for c in group]  # both sides may come from one table
    found = left.groupBy(*group).cogroup(right.withColumnsRenamed(dict(zip(group, theirs))).groupBy(*theirs)).applyInArrow(run, schema)
    return found.groupBy(*keys, "a_id", *([by] if by else [])).agg(F.sum("n").alias("n"), F.min("nearest").alias("nearest"))
