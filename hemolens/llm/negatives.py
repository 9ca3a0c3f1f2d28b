"""Hard negatives of anchors, searched with score bounds along a spanning tree of the anchors.

Anchors come in blocks of at most `BLOCK`, so what the driver holds and sends is bounded; a block
passes twice over all rows: first for the anchors' positives, then for the rows in the score
windows below them. The anchors of a block form a least spanning tree. A row's score with an
anchor lies within (edge length) x (norm of the row) of its score with the parent anchor; a child
is scored anew only where that interval can still meet what it looks for: the running k-th best
of its positives, or one of its windows that a later row could still enter. Where the anchors are
far apart the bounds exclude little, and the block is a matrix product a batch.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.ml.feature import Bucketizer

from hemolens.llm.vectors import matrix, whole_vectors
from hemolens.session import cut_lineage, scratch_path

BLOCK = 4096
CELLS = 1 << 21  # scores that a task holds at once
DENSE = 0.2
EXACT = 2.0**53
LONG = 2**63 - 1
OUT = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"


class Tree:
    """Least spanning tree over the rows of `points`: levels of (children, parents, edge bounds)."""

    def __init__(self, points: np.ndarray):
        p = points.astype(np.float64)
        n = len(p)
        root = int(np.argmin(((p - p.mean(0)) ** 2).sum(1))) if n else 0
        self.root, self.levels = root, []
        best, parent, depth = np.full(n, np.inf), np.full(n, root), np.zeros(n, int)
        inside, at = np.zeros(n, bool), root
        edge = np.zeros(n)
        for _ in range(n - 1):
            inside[at] = True
            d = np.sqrt(((p - p[at]) ** 2).sum(1))
            closer = ~inside & (d < best)
            best[closer], parent[closer] = d[closer], at
            at = int(np.argmin(np.where(inside, np.inf, best)))
            edge[at], depth[at] = best[at] * (1 + 1e-9) + 1e-6, depth[parent[at]] + 1
        for level in range(1, int(depth.max(initial=0)) + 1):
            children = np.flatnonzero(depth == level)
            self.levels.append((children, parent[children], edge[children]))


def scored(anchors: np.ndarray, tree: Tree, rows: np.ndarray, low: np.ndarray, high: np.ndarray, wanted=None):
    """(scores, known) of anchors x rows: known wherever a score in [low, high] of its anchor is possible (and `wanted`).

    Bounds of whole numbers (`object`) ask for scores in whole numbers of any size, all of them.
    """
    if low.dtype == object:
        big = np.clip(anchors.astype(object) @ rows.astype(object).T, -LONG, LONG)
        return big, np.ones(big.shape, bool)
    a, x = anchors.astype(np.float64), rows.astype(np.float64)
    norm = np.sqrt((x * x).sum(1)) * (1 + 1e-9)
    lo, known = np.zeros((len(a), len(x))), np.zeros((len(a), len(x)), bool)
    hi = np.zeros_like(lo)
    lo[tree.root] = hi[tree.root] = x @ a[tree.root]
    known[tree.root] = True
    for children, parents, edges in tree.levels:
        slack = edges[:, None] * norm
        below, above = lo[parents] - slack, hi[parents] + slack
        need = (above >= low[children, None]) & (below <= high[children, None])
        if wanted is not None:
            need &= wanted[children]
        full = need.mean(1) > DENSE
        if full.any():
            who = children[full]
            lo[who] = hi[who] = a[who] @ x.T
            known[who] = True
        for k in np.flatnonzero(~full):
            c, some = children[k], np.flatnonzero(need[k])
            lo[c], hi[c] = below[k], above[k]
            if len(some):
                lo[c, some] = hi[c, some] = x[some] @ a[c]
                known[c, some] = True
    return lo, known


class Best:
    """The first `k` of (score falling, id rising) for many seekers, updated a batch at a time."""

    def __init__(self, seekers: int, k: int, kind: type = float):
        self.k, self.held = k, [[] for _ in range(seekers)]
        self.least, self.last = np.full(seekers, -np.inf, kind), np.full(seekers, LONG)

    def offer(self, at: int, scores: np.ndarray, ids: np.ndarray) -> None:
        held = self.held[at]
        if len(scores) > self.k:
            edge = np.partition(scores, len(scores) - self.k)[len(scores) - self.k]
            scores, ids = scores[scores >= edge], ids[scores >= edge]
        held.extend(sorted(zip((-int(s) for s in scores), (int(i) for i in ids)))[: self.k])
        held.sort()
        del held[self.k :]
        if len(held) == self.k:
            self.least[at], self.last[at] = -held[-1][0], held[-1][1]

    def enters(self, at, scores: np.ndarray, ids: np.ndarray) -> np.ndarray:
        least, last = self.least[at], self.last[at]
        if np.ndim(at):
            least, last = least[:, None], last[:, None]
        return (scores > least) | ((scores == least) & (ids < last))

    def batch(self):
        rows = [(at, -s, i) for at, held in enumerate(self.held) for s, i in held]
        columns = list(zip(*rows)) or [[], [], []]
        return pa.RecordBatch.from_arrays(
            [pa.array(columns[0], pa.int32()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.int64())], ["seeker", "score", "id"]
        )


FOUND = "seeker int, score long, id long"


def first_of(found: DataFrame, keys: list[str], k: int) -> DataFrame:
    order = Window.partitionBy(*keys).orderBy(F.desc("score"), "id")  # k rows of each task
    return found.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= k)


def steps(batches, anchors: int, dim: int):
    """(ids, labels, vectors) in pieces whose score tables fit."""
    size = max(64, CELLS // max(anchors, 1))
    for batch in batches:
        for start in range(0, batch.num_rows, size):
            part = batch.slice(start, size)
            yield part.column(0).to_numpy(zero_copy_only=False), part.column(1).to_numpy(zero_copy_only=False), matrix(part.column(2), dim)


def find_positives(rows: DataFrame, ids, labels, anchors: np.ndarray, k: int, kind: type) -> DataFrame:
    """(seeker, score, id): the first `k` rows of each anchor's label, one spanning tree a label."""
    dim = anchors.shape[1]
    groups = {c: np.flatnonzero(labels == c) for c in np.unique(labels)}
    trees = {c: Tree(anchors[who]) for c, who in groups.items()}

    def run(batches):
        best = Best(len(anchors), k, kind)
        for own, kinds, x in steps(batches, len(anchors), dim):
            for c in np.unique(kinds):
                if c not in groups:
                    continue
                who, there = groups[c], np.flatnonzero(kinds == c)
                scores, known = scored(anchors[who], trees[c], x[there], best.least[who], np.full(len(who), np.inf, kind))
                fit = known & best.enters(who, scores, own[there]) & (own[there] != ids[who][:, None])
                for r in np.flatnonzero(fit.any(1)):
                    best.offer(who[r], scores[r][fit[r]], own[there][fit[r]])
        yield best.batch()

    return first_of(rows.mapInArrow(run, FOUND), ["seeker"], k)


def find_negatives(rows: DataFrame, ids, labels, anchors: np.ndarray, owner, low, high, k: int) -> DataFrame:
    """(seeker, score, id): the first `k` rows of another label in each window [low, high] of its `owner` anchor."""
    dim, tree = anchors.shape[1], Tree(anchors)
    of = [np.flatnonzero(owner == a) for a in range(len(anchors))]
    busy = np.array([len(w) > 0 for w in of], bool)
    top = np.array([max(high[w], default=-np.inf) for w in of], high.dtype)

    def run(batches):
        best = Best(len(owner), k, low.dtype)
        open_at = np.array([min(low[w], default=np.inf) for w in of], low.dtype)
        for own, kinds, x in steps(batches, len(anchors), dim):
            other = busy[:, None] & (labels[:, None] != kinds) & (own != ids[:, None])
            scores, known = scored(anchors, tree, x, open_at, top, other)
            fit = known & other & (scores >= open_at[:, None]) & (scores <= top[:, None])
            for a in np.flatnonzero(fit.any(1)):
                s, i = scores[a][fit[a]], own[fit[a]]
                for w in of[a]:
                    into = (s >= low[w]) & (s <= high[w]) & best.enters(w, s, i)
                    if into.any():
                        best.offer(w, s[into], i[into])
                open_at[a] = min(max(low[w], best.least[w]) for w in of[a])
        yield best.batch()

    return first_of(rows.mapInArrow(run, FOUND), ["seeker"], k)


def side_of(vector: str, b: int) -> Column:
    """Whether a vector lies on the positive side of direction `b`, whose entries are 1 or -1 by hash."""
    turned = F.zip_with(
        vector, F.sequence(F.lit(1), F.size(vector)),
        lambda v, k: F.when(F.xxhash64(k, F.lit(b)) % 2 == 0, v.cast("double")).otherwise(-v.cast("double")),
    )
    return F.aggregate(turned, F.lit(0.0), lambda t, v: t + v) >= 0


def in_blocks(anchors: DataFrame, most: int) -> tuple[DataFrame, int]:
    """The written anchors with `block`: neighbours in a signature of twelve directions, at most `most` in a block."""
    total = anchors.count()
    if total <= most:
        return anchors.withColumn("block", F.lit(0)), min(total, 1)
    bits = sum(side_of("x", b).cast("long") * 2**b for b in range(12))
    keyed = cut_lineage(anchors.withColumn("key", (bits * 2**32 + F.pmod(F.xxhash64("id", "label", "x"), F.lit(2**32))).cast("double")))
    blocks = -(-total * 5 // (4 * most))
    while True:
        cuts = keyed.approxQuantile("key", [k / blocks for k in range(1, blocks)], 0.02 / blocks)
        edges = [-float("inf"), *sorted(set(cuts)), float("inf")]
        out = Bucketizer(splits=edges, inputCol="key", outputCol="block").transform(keyed)
        if out.groupBy("block").count().agg(F.max("count")).first()[0] <= most:
            return cut_lineage(out.withColumn("block", F.col("block").cast("int")).drop("key")), len(edges) - 1
        blocks *= 2


def mine_negatives(
    df: DataFrame, anchor: Column, label: Column, ident: str = "vec_id", vector: str = "embedding", k: int = 5, share: int = 80, block: int = BLOCK
) -> DataFrame:
    """For each anchor and each of its first `k` positives, the first `k` rows of another label in the positive's window.

    `anchor` says which rows of `df` are anchors, `label` is a row's label. The score of two rows is the
    inner product of their vectors in whole numbers (`whole_vectors`); the window of a positive is
    share % of its score to its score, so a positive below zero has none. Ties go to the smaller id.
    Rows with a null id or label, and those that `whole_vectors` leaves out, take no part. A row that
    repeats counts as often as it comes, but rows with an anchor's id are neither its positives
    nor its negatives, and equal anchors are one. Scores beyond a long are cut to its range. An empty
    table, no anchor or one label give an empty or partly empty result; other columns are not read.
    """
    spark = df.sparkSession
    named = df.filter(F.col(f"`{ident}`").isNotNull()).filter(label.isNotNull())
    rows, dim = whole_vectors(
        named, {"id": F.col(f"`{ident}`").cast("long"), "label": label.cast("long"), "anchor": F.coalesce(anchor, F.lit(False))}, vector
    )
    anchors, blocks = in_blocks(cut_lineage(rows.filter("anchor").select("id", "label", "x").distinct()), block)
    rows = rows.select("id", "label", "x")
    reach = rows.agg(F.max(F.greatest(F.array_max("x"), -F.array_min("x")))).first()[0] or 0
    kind = float if reach * reach * dim < EXACT else object
    path = scratch_path(spark, "negatives")
    for b in range(blocks):
        held = anchors.filter(F.col("block") == b).select("id", "label", "x").orderBy("id", "label", "x").collect()  # `block` rows at most
        ids, labels = (np.array([r[c] for r in held], np.int64) for c in ("id", "label"))
        points = np.array([r["x"] for r in held], np.int64).reshape(len(held), dim)
        positives = cut_lineage(find_positives(rows, ids, labels, points, k, kind))
        near = positives.orderBy("seeker", "place").collect()  # k for each anchor of the block
        owner = np.array([r["seeker"] for r in near], np.int64)
        score = [r["score"] for r in near]
        low, high = np.array([-(-share * s // 100) for s in score], kind), np.array(score, kind)
        low[high < 0] = np.inf
        windows = spark.createDataFrame(
            [(w, int(ids[r["seeker"]]), r["id"], r["score"]) for w, r in enumerate(near)], "seeker int, anchor_id long, positive_id long, positive_score long"
        )
        found = find_negatives(rows, ids, labels, points, owner, low, high, k).withColumnsRenamed({"id": "negative_id", "score": "negative_score"})
        named = found.join(F.broadcast(windows), "seeker")
        named.select("anchor_id", "positive_id", F.col("place").alias("rank"), "negative_id", "positive_score", "negative_score").write.mode("append").parquet(path)
    if not blocks:
        return spark.createDataFrame([], OUT)
    return spark.read.schema(OUT).parquet(path)
