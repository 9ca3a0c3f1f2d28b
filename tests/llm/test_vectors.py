"""Whitening, hard negatives and exact copies against brute force, on odd rows too."""

import hashlib
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from hemolens.llm import exact, negatives, queries, whitening

SF = "/root/testdata/sf0.001"
NAN, INF = float("nan"), float("inf")


# exact copies


def plain_copies(rows):
    lower = lambda t: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
    groups = {}
    for i, t in rows:
        groups.setdefault(lower(t), []).append(i)
    return sorted(
        (str(i), str(max((x for x in groups[lower(t)] if x is not None), default=None)), len(groups[lower(t)]), hashlib.sha256(lower(t).encode()).hexdigest())
        for i, t in rows
    )


@pytest.mark.parametrize("counters", [1, 3, 40, exact.COUNTERS])
def test_copies_of_odd_rows(docs_of, counters):
    rng = random.Random(4)
    rows = [(k, rng.choice(["a b", "A B", "c", "Ä", "ä", "", None, "tail " * 50_000])) for k in range(60)] + [(100 + k, f"t{k % 30}") for k in range(50)]
    rows += [(7, "twice"), (7, "twice"), (7, "other"), (None, "no id"), (None, "c"), (None, "no id"), (200, "İI"), (201, "İi")]
    docs = docs_of(rows).withColumns({"keep_id": F.lit("x"), "digest": F.lit(1), "row": F.lit(0), "best": F.lit(2)}).repartition(5)
    got = exact.mark_copies(docs, counters=counters).collect()
    assert sorted((str(r.doc_id), str(r.keep_id), r.group_size, r.text_sha256) for r in got) == plain_copies(rows)
    kept = [r for r in got if r.kept]
    assert len(kept) == len({r.text_sha256 for r in got}) and all(r.doc_id == r.keep_id for r in kept)


def test_sketch_keeps_frequent_values():
    import pyarrow as pa

    rng = random.Random(2)
    values = [b"hot"] * 400 + [b"warm"] * 150 + [str(rng.random()).encode() for _ in range(2000)]
    rng.shuffle(values)
    sketch = exact.Sketch(20)
    for at in range(0, len(values), 100):
        sketch.add(pa.array(values[at : at + 100], pa.binary()))
    held = sketch.trimmed()
    assert len(held) <= 20
    for value, n in ((b"hot", 400), (b"warm", 150)):
        assert n - len(values) / 21 <= held[value] <= n


def test_frequent_digests_are_few_and_none_is_missed(spark):
    rng = random.Random(3)
    rows = [(b"hot",)] * 900 + [(b"warm",)] * 300 + [(str(rng.random()).encode(),) for _ in range(1800)]
    rng.shuffle(rows)
    table = spark.createDataFrame(rows, "digest binary").repartition(7)
    found = {bytes(r.digest) for r in exact.frequent(table, "digest", 20).collect()}
    assert found == {b"hot", b"warm"}


def test_without_copies_keeps_whole_rows(docs_of):
    docs = docs_of([(1, "Same"), (2, "same"), (3, "other"), (3, "other"), (None, "same")])
    left = exact.without_copies(docs)
    assert left.columns == docs.columns
    assert sorted((r.doc_id, r.text) for r in left.collect()) == [(2, "same"), (3, "other")]
    empty = exact.mark_copies(docs_of([]))
    assert empty.count() == 0 and empty.columns == ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]


def test_only_rest_is_shuffled_by_digest(docs_of):
    plan = exact.mark_copies(docs_of([(k, "same" if k % 2 else f"t{k}") for k in range(200)]))._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and plan.count("hashpartitioning(digest") == 1
    assert "LeftAnti" in plan and plan.count("BroadcastHashJoin") == 2


# hard negatives


def plain_negatives(rows, step=3, k=5, share=80):
    usable = [(i, c, [math.floor(256 * v) for v in x]) for i, c, x in rows if i is not None and c is not None and x and all(v is not None and math.isfinite(v) for v in x)]
    out, most = set(), 2**63 - 1
    for i, c, x in usable:
        if i % step:
            continue
        scored = sorted((-max(-most, min(most, sum(a * b for a, b in zip(x, y)))), j, d) for j, d, y in usable if j != i)
        for s, j, _ in [t for t in scored if t[2] == c][:k]:
            fit = [t for t in scored if t[2] != c and share * -s <= 100 * -t[0] <= 100 * -s][:k]
            out |= {(i, j, n, t[1], -s, -t[0]) for n, t in enumerate(fit, 1)}
    return sorted(out)


def vectors_of(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>")


def mined(df, **more):
    return sorted(tuple(r) for r in negatives.mine_negatives(df, F.col("vec_id") % 3 == 0, F.col("label"), **more).collect())


@pytest.mark.parametrize("block", [negatives.BLOCK, 8])
@pytest.mark.parametrize("tight", [False, True])
def test_negatives_equal_brute_force(spark, block, tight):
    rng = np.random.default_rng(5)
    centre = rng.normal(size=(6, 12))
    points = centre[rng.integers(0, 6, 150)] + rng.normal(size=(150, 12)) * (0.02 if tight else 1.0)
    points[100:120] = points[3]  # ties
    rows = [(i, int(rng.integers(0, 3)), x.tolist()) for i, x in enumerate(points)]
    want = plain_negatives(rows)
    assert len(want) > 200
    assert mined(vectors_of(spark, rows).repartition(4), block=block) == want


def test_bounds_spare_scores_of_near_anchors():
    rng = np.random.default_rng(6)
    anchors = np.floor(256 * (rng.normal(size=(1, 16)) + 0.01 * rng.normal(size=(50, 16)))).astype(np.int64)
    rows = np.floor(256 * rng.normal(size=(400, 16))).astype(np.int64)
    exact_scores = anchors @ rows.T
    low = np.quantile(exact_scores, 0.98, axis=1)
    scores, known = negatives.scored(anchors, negatives.Tree(anchors), rows, low, np.full(50, np.inf))
    assert (scores[known] == exact_scores[known]).all() and known[exact_scores >= low[:, None]].all()
    assert known.mean() < 0.3


def test_tree_is_least():
    rng = np.random.default_rng(1)
    p = rng.normal(size=(30, 4))
    edges = [(c, q, e) for level in negatives.Tree(p).levels for c, q, e in zip(*level)]
    assert sorted([int(c) for c, _, _ in edges] + [negatives.Tree(p).root]) == list(range(30))
    order = sorted((float(np.linalg.norm(p[a] - p[b])), a, b) for a in range(30) for b in range(a))
    parent = list(range(30))
    root = lambda v: v if parent[v] == v else root(parent[v])
    least = 0.0
    for d, a, b in order:
        if root(a) != root(b):
            parent[root(a)] = root(b)
            least += d
    assert sum(e for _, _, e in edges) == pytest.approx(least, abs=1e-3)


def test_negatives_of_odd_rows(spark):
    rows = [
        (0, 1, [1.0, 0.0]), (1, 1, [0.9, 0.1]), (2, 2, [0.8, 0.0]), (3, 2, [1.0, 0.2]), (4, None, [1.0, 0.0]), (5, 2, None), (6, 2, [NAN, 1.0]),
        (7, 2, [INF, 0.0]), (9, 2, [None, 1.0]), (None, 2, [1.0, 0.0]), (12, 3, [-1.0, 0.0]), (15, 3, [1.0, 0.0]), (16, 3, [0.0, 0.0]),
        (17, 1, [0.0, 0.0]), (18, 1, []),
    ]
    df = vectors_of(spark, rows).withColumns({"x": F.lit(1), "id": F.lit(2), "score": F.lit(3), "anchor": F.lit("a")})
    assert mined(df) == plain_negatives(rows)
    assert mined(vectors_of(spark, [])) == []
    assert mined(vectors_of(spark, [(1, 1, [1.0])])) == []
    assert mined(vectors_of(spark, [(0, 1, [1.0]), (3, 1, [1.0])])) == []
    large = [(k, k % 2, [2.0**50 * (1 + k % 5), 3.0 * k]) for k in range(12)]
    found = mined(vectors_of(spark, large))
    assert found == plain_negatives(large) and max(r[4] for r in found) == 2**63 - 1


def test_repeated_rows_count_each_and_equal_anchors_once(spark):
    rows = [(0, 1, [1.0, 0.0])] * 2 + [(1, 1, [0.9, 0.0]), (2, 2, [0.85, 0.0]), (2, 2, [0.85, 0.0])]
    assert [(r[0], r[1], r[2], r[3]) for r in mined(vectors_of(spark, rows))] == [(0, 1, 1, 2), (0, 1, 2, 2)]


# whitening


def plain_whitening(rows, k=4):
    ok = [(i, [math.floor(256 * float(c)) for c in x]) for i, x in rows if x and all(c is not None and math.isfinite(c) for c in x)]
    distinct = sorted({tuple(x) for _, x in ok})
    n, sums = len(distinct), [sum(c) for c in zip(*distinct)]
    y = np.array(distinct, float) - np.array(sums) / n
    values, vectors = np.linalg.eigh(y.T @ y / n)
    order = np.argsort(-values)[:k]
    out = []
    for i, x in ok:
        deviation = sum((n * a - s) ** 2 for a, s in zip(x, sums))
        w = (np.array(x) - np.array(sums) / n) @ vectors[:, order] / np.sqrt(values[order])
        out += [(i, j + 1, n, deviation, w[j], values[order[j]] / values.sum()) for j in range(len(order))]
    return out


def check_white(got, want):
    got = sorted(got, key=lambda r: (r[0], r[1], r[3]))
    want = sorted(want, key=lambda r: (r[0], r[1], r[3]))
    assert [tuple(r)[:4] for r in got] == [r[:4] for r in want]
    for c in {r[1] for r in want}:
        a, b = (np.array([r[4] for r in x if r[1] == c]) for x in (got, want))
        assert min(np.abs(a - b).max(), np.abs(a + b).max()) < 1e-8
    assert all(abs(g[5] - w[5]) <= 1e-10 for g, w in zip(got, want)) and all(g[6] < 1e-9 for g in got)


def test_whitening_equals_brute_force(spark):
    rng = np.random.default_rng(2)
    points = rng.normal(size=(300, 10)) * np.linspace(1, 2, 10)
    rows = [(i, x.tolist()) for i, x in enumerate(points)] + [(i + 300, points[i % 3].tolist()) for i in range(40)]
    odd = [(900, None), (901, [None] * 10), (902, [NAN] * 10), (903, [INF] * 10), (904, []), (905, [1.0] * 3)]
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<float>").withColumns({"x": F.lit("x"), "n": F.lit(0), "component": F.lit(0)})
    as_float = [(i, [float(np.float32(c)) for c in x]) for i, x in rows]
    check_white(whitening.whiten(df.repartition(5)).collect(), plain_whitening(as_float))


def test_whitening_of_the_given_table(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/embeddings.parquet").select("vec_id", "embedding").collect()]
    check_white(queries.op11_embedding_whitening(spark, SF).collect(), plain_whitening(rows))


def test_whitening_without_variance(spark):
    table = lambda rows: spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert whitening.whiten(table([])).count() == 0
    assert whitening.whiten(table([(1, None)])).columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    one = whitening.whiten(table([(1, [1.0, 2.0]), (2, [1.0, 2.0])])).collect()
    assert [(r.vec_id, r.component, r.n, r.deviation, r.whitened, r.explained) for r in sorted(one)] == [(v, c, 1, 0, None, None) for v in (1, 2) for c in (1, 2)]
    line = whitening.whiten(table([(k, [float(k), 2.0 * k, 0.0]) for k in range(5)])).collect()
    assert {r.component: r.whitened is None for r in line} == {1: False, 2: True, 3: True}
    assert max(r.identity_error for r in line) < 1e-9 and {round(r.explained, 9) for r in line} == {0.0, 1.0}
    far = whitening.whiten(table([(k, [1e300 * (k % 2), float(k)]) for k in range(4)])).collect()
    assert len(far) == 8 and {r.deviation for r in far} == {None}


def test_solver_restarts_and_equal_values():
    rng = np.random.default_rng(9)
    for y in (rng.normal(size=(600, 200)) * np.linspace(1, 2, 200), np.vstack([np.eye(6), -np.eye(6)]), np.zeros((3, 5))):
        passes = [0]

        def product(v, y=y, passes=passes):
            passes[0] += 1
            return y.T @ (y @ v) / len(y)

        found = whitening.jacobi_davidson(product, y.shape[1], 4)
        want = np.linalg.eigvalsh(y.T @ y / len(y))[::-1][:4]
        assert found.locked == 4 and np.abs(found.values - want).max() <= 1e-12 * max(want[0], 1)
        assert found.residuals.max() <= 1e-12 * max(want[0], 1) and passes[0] < 300
        assert np.abs(found.vectors.T @ found.vectors - np.eye(4)).max() < 1e-12
