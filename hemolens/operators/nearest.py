"""Exact k nearest neighbours of vectors with any number of entries, as a self join on pivot cells.

Every point belongs to the nearest of a few pivots. A cell is sorted by distance to its pivot and
cut into blocks of bounded size, so a block is a ring: a cell, a range of pivot distances. A
first pass finds each point's neighbours inside its own block, which bounds how far the
k-th one can be. A second pass only takes points whose bound reaches into another block: by the
triangle inequality none of a ring's points is nearer than the gap between the ring's range and the
point's distance to that pivot, and none beyond the plane between two pivots is nearer than that plane.
Visits are rows (point, block); a block that many points visit is copied to several tasks.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hemolens.functions import ordered
from hemolens.session import cut_lineage

PIVOTS = 256
BLOCK = 1024
VISITORS = 4096  # visits of a block that one task takes
AT_ONCE = 1 << 22  # numbers held while distances are made
SLACK = 1e-9


def _vectors(column) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else np.empty((0, 0))


def _distances(a: np.ndarray, b: np.ndarray):
    """(start, distances) for a few rows of `a` at a time, from differences, so that equal points are at 0."""
    step = max(1, AT_ONCE // max(b.size, 1))
    for start in range(0, len(a), step):
        d = a[start : start + step, None, :] - b[None]
        yield start, np.sqrt(np.einsum("ijk,ijk->ij", d, d))


def _first(dist: np.ndarray, ids: list, k: int, within: float = np.inf) -> list[tuple[float, object]]:
    """The `k` least (distance, id) pairs not beyond `within`."""
    if len(dist) > k:
        within = min(within, np.partition(dist, k - 1)[k - 1])
    return sorted((float(dist[j]), ids[j]) for j in np.flatnonzero(dist <= within))[:k]


def _in_cells(points: DataFrame, ident: str, pivots: np.ndarray) -> DataFrame:
    """(id, x, cell, r): the nearest pivot and the distance to it."""

    def run(batches):
        for batch in batches:
            x = _vectors(batch.column(1))
            cell, r = np.empty(len(x), np.int32), np.empty(len(x))
            for start, d in _distances(x, pivots):
                at = slice(start, start + len(d))
                cell[at], r[at] = d.argmin(1), d.min(1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell), pa.array(r)], ["id", "x", "cell", "r"])

    kind = points.schema[ident].dataType.simpleString()
    return points.select(ident, "x").mapInArrow(run, f"id {kind}, x array<double>, cell int, r double")


def _blocks(placed: DataFrame, size: int) -> DataFrame:
    """(cell, blk, lo, hi, points): rings of at most `size` points."""
    numbered = ordered.row_numbers(ordered.with_order_bucket(placed, "r"), ["cell"], ["r", "id"], "_rn")
    ring = numbered.withColumn("blk", F.floor((F.col("_rn") - 1) / size).cast("int"))
    return ring.groupBy("cell", "blk").agg(
        F.min("r").alias("lo"), F.max("r").alias("hi"), F.count("*").alias("n"), F.collect_list(F.struct("id", "x")).alias("points")
    )


def _inside_blocks(blocks: DataFrame, kind: str, k: int) -> DataFrame:
    """(id, x, cell, blk, bound, near): neighbours inside a point's own block; the bound is the k-th distance."""

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1)
                points = row.column(2).flatten()
                ids, x = points.field(0).to_pylist(), _vectors(points.field(1))
                near = []
                for start, d in _distances(x, x):
                    d[np.arange(len(d)), start + np.arange(len(d))] = np.inf
                    near += [[(b, v) for v, b in _first(line, ids, k) if v < np.inf] for line in d]
                bound = [m[-1][1] if len(m) == k else float("inf") for m in near]
                n = len(ids)
                yield pa.RecordBatch.from_arrays(
                    [points.field(0), points.field(1), pa.repeat(row.column(0)[0], n), pa.repeat(row.column(1)[0], n), pa.array(bound),
                     pa.array([[{"b_id": b, "dist": v} for b, v in m] for m in near], to_arrow_type(near_type))],
                    ["id", "x", "cell", "blk", "bound", "near"],
                )

    from pyspark.sql.pandas.types import to_arrow_type
    from pyspark.sql.types import ArrayType, StructType

    near_type = ArrayType(StructType.fromDDL(f"b_id {kind}, dist double"))
    schema = f"id {kind}, x array<double>, cell int, blk int, bound double, near array<struct<b_id:{kind},dist:double>>"
    return blocks.select("cell", "blk", "points").mapInArrow(run, schema)


def open_visits(inside: DataFrame, blocks: DataFrame, pivots: np.ndarray, k: int) -> DataFrame:
    """(id, cell, blk, bound): the blocks besides its own that may hold one of a point's `k` nearest.

    What reaches every task is one row a pivot. A block with fewer than k + 1 points gives no bound;
    there it is the least distance within which whole cells must hold k other points.
    """
    cells = {r["cell"]: r for r in blocks.groupBy("cell").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.sum("n").alias("n")).collect()}
    held = sorted(cells)
    lo, hi, n = (np.array([cells[c][name] for c in held], float) for name in ("lo", "hi", "n"))
    middle = pivots[held]
    number, own_at = np.array(held, np.int32), {c: i for i, c in enumerate(held)}
    between = np.concatenate([d for _, d in _distances(middle, middle)]) if held else np.empty((0, 0))
    kind = inside.schema["id"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            ids, x = batch.column(0), _vectors(batch.column(1))
            own = np.array([own_at[c] for c in batch.column(2).to_pylist()], int)
            bound = batch.column(4).to_numpy(zero_copy_only=False).copy()
            for start, d in _distances(x, middle):
                at = np.arange(start, start + len(d))
                reach = d + hi
                order = np.argsort(reach, axis=1)
                enough = np.argmax(np.cumsum(n[order], axis=1) > k, axis=1)
                rows = np.arange(len(d))
                bound[at] = np.minimum(bound[at], reach[rows, order[rows, enough]])
                wide = bound[at] * (1 + SLACK) + SLACK
                home = d[rows, own[at]]
                with np.errstate(divide="ignore", invalid="ignore"):
                    plane = (d * d - (home * home)[:, None]) / (2 * between[own[at]])
                gap = np.maximum(np.maximum(d - hi, lo - d), np.where(np.isfinite(plane), plane, 0.0))
                r, c = np.nonzero(gap <= wide[:, None])
                yield pa.RecordBatch.from_arrays(
                    [ids.take(pa.array(at[r])), pa.array(number[c]), pa.array(d[r, c]), pa.array(wide[r]),
                     pa.array(np.where(c == own[at[r]], batch.column(3).to_numpy(zero_copy_only=False)[at[r]], -1).astype(np.int32))],
                    ["id", "cell", "d", "bound", "home"],
                )

    reached = inside.select("id", "x", "cell", "blk", "bound").mapInArrow(run, f"id {kind}, cell int, d double, bound double, home int")
    visits = reached.join(blocks.select("cell", "blk", "lo", "hi"), "cell")
    meets = (F.col("d") - F.col("hi") <= F.col("bound")) & (F.col("lo") - F.col("d") <= F.col("bound")) & (F.col("blk") != F.col("home"))
    return visits.filter(meets).select("id", "cell", "blk", "bound")


def _visit(visits: DataFrame, inside: DataFrame, blocks: DataFrame, kind: str, k: int) -> DataFrame:
    """(a_id, b_id, dist): up to `k` points of each visited block within the visitor's bound."""
    ring = ["cell", "blk"]
    counts = visits.groupBy(*ring).agg(F.ceil(F.count("*") / VISITORS).cast("int").alias("_slices"))
    callers = visits.join(counts, ring).join(inside.select("id", "x"), "id")
    callers = callers.withColumn("slice", F.pmod(F.xxhash64("id"), F.col("_slices")).cast("int")).select(*ring, "slice", "id", "x", "bound")
    copies = blocks.join(counts, ring).withColumn("slice", F.explode(F.sequence(F.lit(0), F.col("_slices") - 1))).select(*ring, "slice", "points")

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        a, b, dist = [], [], []
        if left.num_rows and right.num_rows:
            points = right.column("points").combine_chunks().flatten()
            ids, x = points.field(0).to_pylist(), _vectors(points.field(1))
            who, bound = left.column("id").to_pylist(), left.column("bound").to_pylist()
            for start, d in _distances(_vectors(left.column("x")), x):
                for i, line in enumerate(d, start):
                    for v, j in _first(line, ids, k, bound[i]):
                        a.append(who[i])
                        b.append(j)
                        dist.append(v)
        own = left.schema.field("id").type
        return pa.table({"a_id": pa.array(a, own), "b_id": pa.array(b, own), "dist": pa.array(dist, pa.float64())})

    keys = [*ring, "slice"]
    return callers.groupBy(*keys).cogroup(copies.groupBy(*keys)).applyInArrow(run, f"a_id {kind}, b_id {kind}, dist double")


def nearest_neighbours(
    points: DataFrame, k: int, ident: str = "atom_id", vector: str = "x", pivots: int = PIVOTS, block: int = BLOCK
) -> DataFrame:
    """(a_id, b_id, dist, place): the exact `k` nearest distinct points of every point (all, if fewer).

    `vector` is an array of one length throughout. Rows with a null id, a null vector or a null or
    NaN entry take no part. Equal vectors are one point, under the least id. Ties go to the
    smaller id. Fewer than two points give no rows.
    """
    whole = F.col(ident).isNotNull() & F.col(vector).isNotNull() & ~F.exists(vector, lambda v: v.isNull() | F.isnan(v))
    used = points.filter(whole).select(ident, F.transform(vector, lambda v: v.cast("double") + F.lit(0.0)).alias("x"))
    distinct = cut_lineage(used.groupBy("x").agg(F.min(ident).alias(ident)))
    total = distinct.count()
    kind = points.schema[ident].dataType.simpleString()
    need = min(k, total - 1)
    if need < 1:
        return points.sparkSession.createDataFrame([], f"a_id {kind}, b_id {kind}, dist double, place int")
    many = max(1, min(pivots, int(total**0.5)))
    chosen = np.array([r["x"] for r in distinct.orderBy(F.xxhash64("x"), ident).limit(many).collect()], float)
    blocks = cut_lineage(_blocks(_in_cells(distinct, ident, chosen), block))
    inside = cut_lineage(_inside_blocks(blocks, kind, need))
    visits = cut_lineage(open_visits(inside, blocks, chosen, need))
    own = inside.select(F.col("id").alias("a_id"), F.explode("near").alias("_n")).select("a_id", "_n.b_id", "_n.dist")
    found = own.unionByName(_visit(visits, inside, blocks, kind, need))
    order = Window.partitionBy("a_id").orderBy("dist", "b_id")  # k rows of each block visited
    return found.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= need)
