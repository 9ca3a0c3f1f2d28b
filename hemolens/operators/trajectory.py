"""Trajectory features from bead rows (G): per frame first, then per run.

A frame is identified by `keys` (run, frame, ...). Only COM- and cell-level rows leave
the first aggregation.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce
from itertools import product

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hemolens.functions import ordered
from hemolens.operators.counting import count_contacts, known
from hemolens.operators.neighbours import contacts, distance
from hemolens.session import cut_lineage


def insertion_depth(df: DataFrame, keys: Sequence[str], peptide: Column, membrane: Column, deep: float = 2.0) -> DataFrame:
    """Peptide COM z minus membrane midplane z per frame; null where a frame lacks one of them."""
    depth = F.avg(F.when(peptide, F.col("z"))) - F.avg(F.when(membrane, F.col("z")))
    return df.groupBy(*keys).agg(depth.alias("depth")).withColumn("deep", F.col("depth") > deep)


def tilt_angle(df: DataFrame, keys: Sequence[str], bead: str = "bead") -> DataFrame:
    """Angle in degrees between the first-to-last bead vector and z."""
    ends = [F.max_by(a, bead) - F.min_by(a, bead) for a in "xyz"]
    spans = df.groupBy(*keys).agg(*[e.alias(f"d{a}") for e, a in zip(ends, "xyz")])
    norm = F.sqrt(F.col("dx") * F.col("dx") + F.col("dy") * F.col("dy") + F.col("dz") * F.col("dz"))
    cosine = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.try_divide(F.col("dz"), norm)))
    return spans.select(*keys, F.when(norm > 0, F.degrees(F.acos(cosine))).alias("tilt_deg"))


def lipid_contacts(peptide: DataFrame, lipids: DataFrame, keys: Sequence[str], kind: str, cutoff: float = 0.6,
                   box: Sequence[float] | None = None, ident: str = "atom_id") -> DataFrame:
    """Contacts per frame and lipid type."""
    found = count_contacts(peptide, lipids, cutoff, keys, ident, box, by=kind)
    return found.groupBy(*keys, kind).agg(F.sum("n").alias("contacts"))


def center_of_mass(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.groupBy(*keys).agg(*[F.avg(a).alias(a) for a in "xyz"])


def _stars(edges: DataFrame, keys: list[str], upward: bool) -> DataFrame:
    """One contraction step on edges (keys, a, b, a < b): neighbours on one side of a point move to the least one around it."""
    both = edges.select(*keys, F.col("a").alias("u"), F.col("b").alias("v")).unionByName(
        edges.select(*keys, F.col("b").alias("u"), F.col("a").alias("v"))
    )
    near = both if upward else both.filter("v < u")
    least = near.groupBy(*keys, "u").agg(F.min("v").alias("_m")).withColumn("m", F.least("u", "_m")).drop("_m")
    moved = ordered.join_all(near.filter("v > u") if upward else near, least, [*keys, "u"]).select(*keys, F.col("m").alias("a"), F.col("v").alias("b"))
    if not upward:
        moved = moved.unionByName(least.select(*keys, F.col("m").alias("a"), F.col("u").alias("b")))
    return moved.filter("a <> b").select(*keys, F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def connected_labels(nodes: DataFrame, edges: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, id, label): the smallest id reachable over `edges` (keys, src, dst) within a frame.

    Star contraction, frame by frame in one pass: edges move towards the least id around them until every
    component is a star. A frame whose edges a round has left as they were is settled and leaves the loop with its
    stars; rounds only shuffle the frames that still move, and end when none is left. Their number
    grows with the logarithm of the largest component. Each round is a table in the shared folder.
    """
    keys = list(keys)
    open_ = cut_lineage(
        edges.filter("src <> dst").select(*keys, F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).distinct()
    )
    mark = lambda e, n: e.groupBy(*keys).agg(F.count("*").alias(f"_n{n}"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias(f"_h{n}"))
    settled = []
    while not open_.isEmpty():
        moved = cut_lineage(_stars(_stars(open_, keys, True), keys, False))
        same = ordered.join_all(mark(moved, 1), mark(open_, 0), keys).select(*keys, ((F.col("_n0") == F.col("_n1")) & (F.col("_h0") == F.col("_h1"))).alias("_done"))
        flagged = cut_lineage(ordered.join_all(moved, same, keys))
        settled.append(flagged.filter("_done").drop("_done"))
        open_ = flagged.filter("NOT _done").drop("_done")
    points = nodes.select(*keys, "id")
    if not settled:
        return points.withColumn("label", F.col("id"))
    stars = reduce(DataFrame.unionByName, settled).select(*keys, F.col("b").alias("id"), F.col("a").alias("_label"))
    return ordered.join_all(points, stars, [*keys, "id"], "left").select(*keys, "id", F.coalesce("_label", "id").alias("label"))


FINE = ("_fx", "_fy", "_fz")
SIGNS = list(product((-1, 0, 1), repeat=3))
FEW_PAIRS = 4096


def _fine_sides(eps: float, box: Sequence[float] | None) -> list[tuple[float, int]]:
    """(side, number) of cells along each axis, such that two points of a cell are always within `eps`; 0 for open edges."""
    side = eps / 3**0.5 * (1 - 1e-9)
    if box is None:
        return [(side, 0)] * 3
    numbers = [max(1, math.ceil(length / side)) for length in box]
    return [(length / n, n) for length, n in zip(box, numbers)]


def _fine(df: DataFrame, eps: float, box: Sequence[float] | None) -> DataFrame:
    cols = {}
    for (side, n), c, a, length in zip(_fine_sides(eps, box), FINE, "xyz", box or (None,) * 3):
        at = F.floor((F.col(a) if box is None else F.pmod(F.col(a), F.lit(length))) / side)
        cols[c] = (at if box is None else F.least(at, F.lit(n - 1))).cast("long")
    return df.withColumns(cols)


def _fine_around(eps: float, box: Sequence[float] | None) -> Column:
    """(cell, way) of the other cells that can hold points within `eps`; `way` is the place in `SIGNS` of the direction there."""
    steps = []
    for side, n in _fine_sides(eps, box):
        reach = math.ceil(eps / side)
        steps.append(range(-reach, reach + 1) if not n or 2 * reach < n else range(n))
    cells = []
    for offset in product(*steps):
        moved = [F.col(c) + F.lit(o).cast("long") for c, o in zip(FINE, offset)]
        if box is not None:
            moved = [F.pmod(m, F.lit(n).cast("long")) for m, (_, n) in zip(moved, _fine_sides(eps, box))]
        way = SIGNS.index(tuple((o > 0) - (o < 0) for o in offset))
        cells.append(F.struct(*[m.alias(c) for m, c in zip(moved, FINE)], F.lit(way).alias("way")))
    return F.array(*cells)


def _core_cells(core: DataFrame, keys: list[str], box: Sequence[float] | None) -> DataFrame:
    """(keys, cell, label, m, far): least id and number of a cell's core points, and the one that lies farthest each way of `SIGNS`."""
    place = {a: F.col(a) if box is None else F.pmod(F.col(a), F.lit(box[i])) for i, a in enumerate("xyz")}
    far = [
        F.max_by(F.struct("x", "y", "z"), sum((s * place[a] for s, a in zip(signs, "xyz")), F.lit(0.0))) for signs in SIGNS
    ]
    return core.groupBy(*keys, *FINE).agg(F.min("id").alias("label"), F.count("*").alias("m"), F.array(*far).alias("far"))


def _cell_labels(core: DataFrame, keys: list[str], eps: float, box: Sequence[float] | None) -> DataFrame:
    """(keys, cell, label): the least core id that is reachable from the core points of each cell.

    Neighbouring cells are linked first by the one point of each that lies farthest towards the other. Only
    cells that are then still apart are compared in full: by pairs of points where these are few, else by
    blocks (`counting`).
    """
    cells = cut_lineage(_core_cells(core, keys, box))
    there = F.explode(_fine_around(eps, box)).alias("_there")
    a = cells.select(*keys, *FINE, F.col("label").alias("a"), F.col("m").alias("a_m"), F.col("far").alias("a_far"), there)
    a = a.select(*keys, "a", "a_m", "a_far", F.col("_there.way").alias("way"), *[F.col(f"_there.{c}").alias(c) for c in FINE])
    b = cells.select(*keys, *FINE, F.col("label").alias("b"), F.col("m").alias("b_m"), F.col("far").alias("b_far"))
    pairs = a.join(b, [*keys, *FINE]).filter("a < b")
    ends = pairs.select(
        *keys, "a", "b", (F.col("a_m") * F.col("b_m")).alias("m"), F.get("a_far", F.col("way")).alias("p"),
        F.get("b_far", len(SIGNS) - 1 - F.col("way")).alias("q"),
    )
    apart = ends.select("*", *[F.col(f"p.{x}").alias(f"p_{x}") for x in "xyz"], *[F.col(f"q.{x}").alias(f"q_{x}") for x in "xyz"])
    near = cut_lineage(apart.select(*keys, "a", "b", "m", (distance(box, "p_", "q_") <= eps).alias("linked")))
    nodes = cells.select(*keys, F.col("label").alias("id"))
    edge = [*keys, F.col("a").alias("src"), F.col("b").alias("dst")]
    first = cut_lineage(connected_labels(nodes, near.filter("linked").select(*edge), keys))
    of = {x: first.select(*keys, F.col("id").alias(x), F.col("label").alias(f"{x}_label")) for x in "ab"}
    open_ = cut_lineage(
        near.filter("NOT linked").select(*keys, "a", "b", "m").distinct().join(of["a"], [*keys, "a"]).join(of["b"], [*keys, "b"])
        .filter("a_label <> b_label")
    )
    named = cells.select(*keys, *FINE, F.col("label").alias("id")).join(first, [*keys, "id"]).drop("id")
    if open_.isEmpty():
        return named
    at = cells.select(*keys, *FINE, F.col("label").alias("cell")).join(core, [*keys, *FINE]).drop(*FINE)
    group = [*keys, "a_label", "b_label"]

    def sides(some: DataFrame) -> list[DataFrame]:
        return [some.join(at.withColumnRenamed("cell", x), [*keys, x]).select(*group, "a", "b", "id", "x", "y", "z") for x in "ab"]

    p, q = (d.select(*group, "a", "b", *[F.col(x).alias(f"{n}_{x}") for x in "xyz"]) for d, n in zip(sides(open_.filter(F.col("m") <= FEW_PAIRS)), "pq"))
    met = p.join(q, [*group, "a", "b"]).filter(distance(box, "p_", "q_") <= eps).select(*group).distinct()
    many = open_.filter(F.col("m") > FEW_PAIRS)
    if not many.isEmpty():
        met = met.unionByName(count_contacts(*sides(many), eps, [*group, "a", "b"], "id", box).select(*group).distinct())
    links = met.select(*keys, F.col("a_label").alias("src"), F.col("b_label").alias("dst"))
    last = connected_labels(first.select(*keys, F.col("label").alias("id")).distinct(), links, keys)
    return named.withColumnRenamed("label", "id").join(last, [*keys, "id"]).drop("id")


def dbscan(coms: DataFrame, keys: Sequence[str], eps: float, min_pts: int, ident: str = "mol",
           box: Sequence[float] | None = None) -> DataFrame:
    """(keys, id, cluster): density clusters per frame; noise has a null cluster. Ids are distinct in a frame.

    A border point joins the neighbouring core with the lowest cluster label.

    Points meet in cells so small that all of a cell are neighbours: a cell with `min_pts` points is all core, and
    clusters are components of cells. Only points of sparser cells are looked up one by one, at most `min_pts - 1` a
    cell, so rows and links grow with the points and not with their pairs.
    """
    keys = list(keys)
    points = coms.select(*keys, F.col(ident).alias("id"))
    placed = _fine(known(coms.select(*keys, F.col(ident).alias("id"), *[F.col(a).cast("double").alias(a) for a in "xyz"]), [*keys, "id"]), eps, box)
    placed = cut_lineage(placed)
    counts = placed.groupBy(*keys, *FINE).agg((F.count("*") >= min_pts).alias("_dense"))
    placed = cut_lineage(placed.join(counts, [*keys, *FINE]))
    sparse = placed.filter("NOT _dense").drop("_dense", *FINE)
    around = count_contacts(sparse, placed, eps, keys, "id", box).filter(F.col("n") >= min_pts)  # a point is near itself
    more = around.select(*keys, F.col("a_id").alias("id"), F.lit(True).alias("_core"))
    placed = cut_lineage(placed.join(more, [*keys, "id"], "left").withColumn("_core", F.col("_dense") | F.col("_core").isNotNull()).drop("_dense"))
    core = placed.filter("_core").drop("_core")
    labels = cut_lineage(core.join(_cell_labels(core, keys, eps, box), [*keys, *FINE]).drop(*FINE))
    reach = contacts(placed.filter("NOT _core"), labels, eps, keys, "id", box, carry_b=["label"])
    border = reach.groupBy(*keys, F.col("a_id").alias("id")).agg(F.min("b_label").alias("cluster"))
    found = labels.select(*keys, "id", F.col("label").alias("cluster")).unionByName(border)
    return points.join(found, [*keys, "id"], "left").select(*keys, "id", "cluster")


def peptide_clusters(coms: DataFrame, keys: Sequence[str], eps: float, min_pts: int, ident: str = "mol",
                     box: Sequence[float] | None = None) -> DataFrame:
    """Per frame: number of clusters, largest and mean oligomer size, unclustered peptides."""
    members = dbscan(coms, keys, eps, min_pts, ident, box)
    sizes = members.groupBy(*keys, "cluster").agg(F.count("*").alias("size"))
    grouped = F.col("cluster").isNotNull()
    return sizes.groupBy(*keys).agg(
        F.count(F.when(grouped, 1)).alias("n_clusters"),
        F.max(F.when(grouped, F.col("size"))).alias("max_size"),
        F.avg(F.when(grouped, F.col("size"))).alias("mean_size"),
        F.coalesce(F.sum(F.when(~grouped, F.col("size"))), F.lit(0)).alias("noise"),
    )


def cluster_stability(pairs: DataFrame, keys: Sequence[str], frame: str = "frame") -> DataFrame:
    """Per pair: frames together, share of those after which it is still together in the next frame.

    `pairs` has one row per (pair, frame); the next frame is found by an equi join, so a
    pair's frames need not meet in one task.
    """
    following = pairs.select(*keys, (F.col(frame) - 1).alias(frame), F.lit(1).alias("_stays"))
    joined = pairs.select(*keys, frame).join(following, [*keys, frame], "left")
    return joined.groupBy(*keys).agg(
        F.count("*").alias("frames"), F.avg(F.coalesce("_stays", F.lit(0)).cast("double")).alias("stay_share")
    )


def membrane_thickness(heads: DataFrame, keys: Sequence[str], upper: Column) -> DataFrame:
    """Mean z of upper heads minus mean z of lower heads, per key."""
    top, bottom = F.avg(F.when(upper, F.col("z"))), F.avg(F.when(~upper, F.col("z")))
    return heads.groupBy(*keys).agg((top - bottom).alias("thickness"))


def thickness_map(heads: DataFrame, keys: Sequence[str], upper: Column, cell: float) -> DataFrame:
    """Thickness per xy cell; cells with one leaflet only are left out."""
    placed = heads.withColumns({"cx": F.floor(F.col("x") / cell), "cy": F.floor(F.col("y") / cell)})
    return membrane_thickness(placed, [*keys, "cx", "cy"], upper).filter("thickness IS NOT NULL")


def thickness_contrast(cells: DataFrame, peptide: DataFrame, keys: Sequence[str], cell: float, radius: float) -> DataFrame:
    """Mean thickness near some peptide COM (cell centres within `radius` in xy), elsewhere, and the difference.

    A frame may have several peptides; a cell is near if any of them is. Peptides list the cells
    around them, so cells and peptides meet by an equi join. Frames without a peptide are left out.
    """
    keys = list(keys)
    span = lambda c: F.sequence(F.floor((F.col(c) - radius) / cell), F.floor((F.col(c) + radius) / cell))
    listed = peptide.select(*keys, "x", "y", F.explode(span("x")).alias("cx")).select("*", F.explode(span("y")).alias("cy"))
    dx = (F.col("cx") + 0.5) * cell - F.col("x")
    dy = (F.col("cy") + 0.5) * cell - F.col("y")
    close = listed.filter(dx * dx + dy * dy <= radius * radius).select(*keys, "cx", "cy").distinct()
    marked = cells.join(close.withColumn("_near", F.lit(True)), [*keys, "cx", "cy"], "left")
    marked = marked.join(peptide.select(*keys).distinct(), keys, "left_semi")
    near = F.col("_near").isNotNull()
    local, far = F.avg(F.when(near, F.col("thickness"))), F.avg(F.when(~near, F.col("thickness")))
    return marked.groupBy(*keys).agg(local.alias("local"), far.alias("far"), (local - far).alias("delta"))


def midplane_water(df: DataFrame, keys: Sequence[str], water: Column, membrane: Column, h: float) -> DataFrame:
    """Water beads within `h` of the membrane midplane, for every frame with a membrane; only water meets the midplanes."""
    keys = list(keys)
    mid = df.filter(membrane).groupBy(*keys).agg(F.avg("z").alias("_mid"))
    near = df.filter(water).select(*keys, "z").join(mid, keys).filter(F.abs(F.col("z") - F.col("_mid")) <= h)
    counted = near.groupBy(*keys).agg(F.count("*").alias("waters"))
    return mid.select(*keys).join(counted, keys, "left").withColumn("waters", F.coalesce("waters", F.lit(0).cast("long")))


def tail_order(df: DataFrame, keys: Sequence[str], lipid: str = "mol", bead: str = "bead") -> DataFrame:
    """Mean (3 cos^2 - 1)/2 of consecutive bead vectors against z; a chain is a handful of beads."""
    w = Window.partitionBy(*keys, lipid).orderBy(bead)
    steps = df.select(*keys, *[(F.lead(a).over(w) - F.col(a)).alias(f"d{a}") for a in "xyz"])
    sq = {a: F.col(f"d{a}") * F.col(f"d{a}") for a in "xyz"}
    cos2 = F.try_divide(sq["z"], sq["x"] + sq["y"] + sq["z"])
    return steps.groupBy(*keys).agg(F.avg((3 * cos2 - 1) / 2).alias("order_parameter"))


def density_defects(heads: DataFrame, keys: Sequence[str], cell: float, lo: Sequence[float], hi: Sequence[float]) -> DataFrame:
    """Empty xy cells of each frame inside the patch [lo, hi)."""
    keys = list(keys)
    nx, ny = (max(1, round((hi[i] - lo[i]) / cell)) for i in (0, 1))
    occupied = heads.select(
        *keys,
        F.floor((F.col("x") - lo[0]) / cell).cast("int").alias("cx"),
        F.floor((F.col("y") - lo[1]) / cell).cast("int").alias("cy"),
    ).distinct()
    grid = (
        heads.select(*keys).distinct()
        .withColumn("cx", F.explode(F.sequence(F.lit(0), F.lit(nx - 1))))
        .withColumn("cy", F.explode(F.sequence(F.lit(0), F.lit(ny - 1))))
    )
    return grid.join(occupied, [*keys, "cx", "cy"], "left_anti")


def thickness_gate(df: DataFrame, low: float = 4.5, high: float = 5.0) -> DataFrame:
    return df.filter(F.col("thickness").between(low, high))
