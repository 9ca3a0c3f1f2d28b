"""Whitening of vectors along their leading components, found by Jacobi-Davidson.

The covariance is never formed. Its products with a few directions at a time are Spark passes over
packed blocks of the fit list: each task adds up (x - mean)^T ((x - mean) V) of its blocks, and one
small array a task is summed by entry. On the driver are only arrays of (dimensions x directions).
A round takes the Ritz pairs of the search space (Rayleigh-Ritz), locks the leading ones
whose residual has reached double precision, and solves the correction equations of the others,
projected against everything locked and sought, by a few MINRES steps, all at once: a step is one
pass for all of them. The corrections widen the space, which is cut back to its best Ritz
vectors when it is full.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hemolens.llm.vectors import matrix, whole_vectors
from hemolens.session import cut_lineage

EPS = np.finfo(float).eps
PACK = 4096
MINRES_STEPS = 4
GUARD = 4  # further directions that are corrected along with those wanted
SPACE = 64  # most directions of the search space
ROUNDS = 300


def packed(fit: DataFrame, dim: int) -> DataFrame:
    """(rows, kind, data): up to `PACK` vectors as the bytes of whole numbers of the least width that holds them."""

    def run(batches):
        for batch in batches:
            for start in range(0, batch.num_rows, PACK):
                x = matrix(batch.slice(start, PACK).column(0), dim)
                kind = next(k for k in ("<i2", "<i4", "<i8") if k == "<i8" or np.abs(x.astype(float)).max() < np.iinfo(k).max)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([len(x)], pa.int64()), pa.array([kind]), pa.array([x.astype(kind).tobytes()], pa.binary())], ["rows", "kind", "data"]
                )

    return fit.mapInArrow(run, "rows long, kind string, data binary")


def blocks_of(batch: pa.RecordBatch, dim: int):
    for kind, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
        yield np.frombuffer(data, kind).reshape(-1, dim)


def totals(blocks: DataFrame, dim: int) -> tuple[int, list[int]]:
    """Number of vectors and exact sum of every entry."""

    def run(batches):
        n, sums = 0, [0] * dim
        for batch in batches:
            for x in blocks_of(batch, dim):
                n += len(x)
                if np.abs(x.astype(float)).max() * len(x) < 2.0**62:
                    sums = [s + int(v) for s, v in zip(sums, x.sum(0, dtype=np.int64))]
                else:
                    sums = [s + sum(map(int, column)) for s, column in zip(sums, x.T)]
        yield pa.RecordBatch.from_arrays([pa.array([-1, *range(dim)], pa.int32()), pa.array([str(v) for v in (n, *sums)])], ["k", "v"])

    made = blocks.select("kind", "data").mapInArrow(run, "k int, v string")
    rows = made.groupBy("k").agg(F.sum(F.col("v").cast("decimal(38,0)")).alias("v")).collect()  # one row an entry
    found = {r["k"]: int(r["v"]) for r in rows}
    return found.get(-1, 0), [found.get(k, 0) for k in range(dim)]


@dataclass
class Centred:
    """The fit list, about its mean."""

    blocks: DataFrame
    dim: int
    n: int
    sums: list[int]
    passes: int = 0

    @property
    def mean(self) -> np.ndarray:
        return np.array([s / self.n for s in self.sums])

    def total(self, part: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
        """Sum over all blocks of `part(x - mean)`, a flat array: one array a task, summed by entry in Spark."""
        dim, mean = self.dim, self.mean

        def run(batches):
            out = None
            for batch in batches:
                for x in blocks_of(batch, dim):
                    value = part(x.astype(np.float64) - mean)
                    out = value if out is None else out + value
            if out is not None:
                yield pa.RecordBatch.from_arrays([pa.array(range(len(out)), pa.int32()), pa.array(out)], ["k", "v"])

        self.passes += 1
        rows = self.blocks.select("kind", "data").mapInArrow(run, "k int, v double").groupBy("k").agg(F.sum("v").alias("v")).collect()
        return np.array([v for _, v in sorted((r["k"], r["v"]) for r in rows)])

    def product(self, directions: np.ndarray) -> np.ndarray:
        """Covariance times `directions` (dimensions x few)."""
        return self.total(lambda y: (y.T @ (y @ directions)).ravel()).reshape(directions.shape) / self.n


def apart(new: np.ndarray, *from_: np.ndarray) -> np.ndarray:
    """An orthonormal basis of what `new` adds to the spans of `from_`."""
    old = np.hstack(from_)
    for _ in range(2):
        new = new - old @ (old.T @ new)
        size = np.sqrt((new * new).sum(0))
        new = new[:, size > 1e3 * EPS] / size[size > 1e3 * EPS]
    out = []
    for v in new.T:
        for _ in range(2):
            for w in out:
                v = v - w * (w @ v)
            v = v - old @ (old.T @ v)
        if (size := np.sqrt(v @ v)) > 1e-8:
            out.append(v / size)
    return np.array(out).T if out else np.empty((len(new), 0))


def minres(apply: Callable[[np.ndarray], np.ndarray], right: np.ndarray, steps: int) -> np.ndarray:
    """`steps` MINRES steps for every column of `right`, each its own symmetric system; `apply` takes all columns at once."""
    tiny = np.finfo(float).tiny
    unit = lambda v, size: np.where(size > tiny, v / np.maximum(size, tiny), 0.0)
    off = np.sqrt((right * right).sum(0))
    v, before = unit(right, off), np.zeros_like(right)
    w, w_before, x, left = np.zeros_like(right), np.zeros_like(right), np.zeros_like(right), off.copy()
    cos, cos_before, sin, sin_before = np.ones_like(off), np.ones_like(off), np.zeros_like(off), np.zeros_like(off)
    for _ in range(steps):
        p = apply(v)
        diagonal = (v * p).sum(0)
        p = p - diagonal * v - off * before
        down = np.sqrt((p * p).sum(0))
        corner = cos * diagonal - cos_before * sin * off
        length = np.hypot(corner, down)
        direction = unit(v - (sin_before * off) * w_before - (sin * diagonal + cos_before * cos * off) * w, length)
        cos_before, sin_before = cos, sin
        cos, sin = unit(corner, length), unit(down, length)
        x = x + cos * left * direction
        left = -sin * left
        before, v, off = v, unit(p, down), down
        w_before, w = w, direction
    return x


@dataclass
class Found:
    values: np.ndarray
    vectors: np.ndarray
    residuals: np.ndarray
    rounds: int
    locked: int


def jacobi_davidson(product: Callable[[np.ndarray], np.ndarray], dim: int, wanted: int, seed: int = 7) -> Found:
    """The `wanted` leading eigenpairs of a symmetric positive semidefinite operator.

    A pair is locked when its residual is at most 64 roundings of the largest eigenvalue, or when the
    search space is all that is left of the whole space, where a residual is rounding alone. Pairs lock in
    falling order; among equal eigenvalues any orthonormal choice is right.
    """
    done = np.empty((dim, 0))
    space = np.linalg.qr(np.random.default_rng(seed).normal(size=(dim, min(dim, wanted + GUARD))))[0]
    image = product(space)
    most, rounds, scale = min(dim, max(SPACE, 3 * (wanted + GUARD))), 0, 0.0
    while done.shape[1] < wanted and rounds < ROUNDS:
        rounds += 1
        small = space.T @ image
        values, turn = np.linalg.eigh((small + small.T) / 2)
        values, turn = values[::-1], turn[:, ::-1]
        space, image = space @ turn, image @ turn
        scale = max(scale, values[0])
        rest = image - space * values
        rest -= done @ (done.T @ rest)
        size = np.sqrt((rest * rest).sum(0))
        whole = space.shape[1] + done.shape[1] >= dim
        fit = 0
        while fit < min(wanted - done.shape[1], space.shape[1]) and (whole or size[fit] <= 64 * EPS * scale):
            fit += 1
        done, space, image, rest, values = np.hstack([done, space[:, :fit]]), space[:, fit:], image[:, fit:], rest[:, fit:], values[fit:]
        if done.shape[1] >= wanted:
            break
        seek = min(wanted - done.shape[1] + GUARD, space.shape[1])
        held = np.hstack([done, space[:, :seek]])
        clear = lambda t: t - held @ (held.T @ t)
        step = lambda t: clear(product(t) - t * values[:seek])
        correction = minres(step, -clear(rest[:, :seek]), MINRES_STEPS)
        if space.shape[1] + seek > most - done.shape[1] and most < dim:
            keep = wanted + 2 * GUARD
            space, image = space[:, :keep], image[:, :keep]
        new = apart(correction, done, space)
        if not new.shape[1]:  # the corrections vanish in rounding: look in a new direction
            new = apart(np.random.default_rng(seed + rounds).normal(size=(dim, seek)), done, space)
        space, image = np.hstack([space, new]), np.hstack([image, product(new)])
    vectors = np.hstack([done, space[:, : wanted - done.shape[1]]])
    image = product(vectors)
    values, turn = np.linalg.eigh((vectors.T @ image + image.T @ vectors) / 2)
    order = np.argsort(-values, kind="stable")
    values, vectors, image = values[order], vectors @ turn[:, order], image @ turn[:, order]
    return Found(values, vectors, np.sqrt(((image - vectors * values) ** 2).sum(0)), rounds, done.shape[1])


def deviations(x: np.ndarray, n: int, sums: list[int]) -> pa.Array:
    """Sum over entries of (n x - S)^2, exact; null where it is beyond a long."""
    rough = ((x.astype(float) * n - np.array(sums, float)) ** 2).sum(1)
    fits = max(map(abs, sums), default=0) < 2**62 and np.abs(x.astype(float)).max(initial=0) * n < 2.0**62
    out, sure = [None] * len(x), (rough < 2.0**62) & fits
    if sure.any():
        d = x[sure] * n - np.array(sums, np.int64)
        for k, v in zip(np.flatnonzero(sure), (d * d).sum(1).tolist()):
            out[k] = v
    for k in np.flatnonzero(~sure & (rough < 2.0**64)):
        v = sum((int(a) * n - s) ** 2 for a, s in zip(x[k], sums))
        out[k] = v if v < 2**63 else None
    return pa.array(out, pa.int64())


OUT = "component int, n long, deviation long, whitened double, explained double, identity_error double"


def whiten(df: DataFrame, ident: str = "vec_id", vector: str = "embedding", components: int = 4) -> DataFrame:
    """(ident, component, n, deviation, whitened, explained, identity_error) for every row and leading component.

    Rows that `whole_vectors` leaves out (null, empty, non-finite, of an unusual length) take no part. The
    fit list has every distinct vector once; rows that repeat are all returned. Components are
    numbered by falling eigenvalue; equal eigenvalues give some orthonormal choice. A component without
    variance (no more than rounding leaves) has null `whitened`; without any variance, `explained` and
    `identity_error` are null too. Vectors of fewer entries have as many components as entries. An empty
    table gives an empty result. Other columns are not read.
    """
    spark = df.sparkSession
    kind = df.schema[ident].dataType.simpleString()
    rows, dim = whole_vectors(df, {ident: F.col(f"`{ident}`")}, vector)
    if not dim:
        return spark.createDataFrame([], f"`{ident}` {kind}, {OUT}")
    blocks = cut_lineage(packed(rows.select("x").distinct(), dim))
    n, sums = totals(blocks, dim)
    fit = Centred(blocks, dim, n, sums)
    trace = float(fit.total(lambda y: np.array([(y * y).sum()]))[0]) / n
    found = jacobi_davidson(fit.product, dim, min(components, dim))
    usable = found.values > 64 * dim * EPS * trace
    directions = found.vectors[:, usable] / np.sqrt(found.values[usable])
    k = directions.shape[1]
    error = None
    if k:
        spread = fit.total(lambda y: np.concatenate([(y @ directions).sum(0), ((y @ directions).T @ (y @ directions)).ravel()])) / n
        error = float(np.abs(spread[k:].reshape(k, k) - np.outer(spread[:k], spread[:k]) - np.eye(k)).max())
    explained = [float(max(v, 0.0) / trace) if trace > 0 else None for v in found.values]
    mean = fit.mean

    def run(batches):
        for batch in batches:
            x = matrix(batch.column(1), dim)
            w = (x.astype(np.float64) - mean) @ directions
            white = [[*r, *[None] * (len(explained) - k)] for r in w.tolist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), deviations(x, n, sums), pa.array(white, pa.list_(pa.float64()))], ["id", "deviation", "white"])

    made = rows.select(ident, "x").mapInArrow(run, f"id {kind}, deviation long, white array<double>")
    share = F.array(*[F.lit(v).cast("double") for v in explained])
    return made.select("id", "deviation", F.posexplode("white").alias("at", "whitened")).select(
        F.col("id").alias(ident), (F.col("at") + 1).cast("int").alias("component"), F.lit(n).cast("long").alias("n"), "deviation", "whitened",
        share[F.col("at")].alias("explained"), F.lit(error).cast("double").alias("identity_error"),
    )
