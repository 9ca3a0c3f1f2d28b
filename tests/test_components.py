"""Connected components over many frames."""

import random

from hemolens.operators import trajectory as traj


def plain(nodes, edges):
    label = {n: n for n in nodes}

    def root(n):
        while label[n] != n:
            n = label[n]
        return n

    for f, a, b in edges:
        x, y = root((f, a)), root((f, b))
        if x != y:
            label[max(x, y)] = min(x, y)
    return {n: root(n)[1] for n in nodes}


def test_components_of_frames_that_settle_at_different_times(spark, monkeypatch):
    rng = random.Random(2)
    nodes = [(f, i) for f in range(12) for i in range(120)]
    edges = [(0, i, i + 1) for i in range(119)]  # a chain takes longest
    edges += [(1, 0, i) for i in range(1, 120)] + [(2, 119 - i, 118 - i) for i in range(60)]
    edges += [(f, *rng.sample(range(120), 2)) for f in range(3, 11) for _ in range(90)]
    rng.shuffle(edges)
    sizes, keep = [], traj._stars

    def watched(e, keys, upward):
        if upward:
            sizes.append(e.select("f").distinct().count())
        return keep(e, keys, upward)

    monkeypatch.setattr(traj, "_stars", watched)
    both = edges + [(f, b, a) for f, a, b in edges] + [(5, 7, 7)]
    got = traj.connected_labels(spark.createDataFrame(nodes, "f int, id long"), spark.createDataFrame(both, "f int, src long, dst long"), ["f"])
    assert {(r.f, r.id): r.label for r in got.collect()} == plain(nodes, edges)
    assert sizes[0] == 11 and sizes[-1] < 11 and sizes == sorted(sizes, reverse=True) and len(sizes) <= 12


def test_no_edges_and_null_frames(spark):
    nodes = spark.createDataFrame([(None, 1), (None, 2), (3, 1)], "f int, id long")
    none = spark.createDataFrame([], "f int, src long, dst long")
    assert {(r.f, r.id, r.label) for r in traj.connected_labels(nodes, none, ["f"]).collect()} == {(None, 1, 1), (None, 2, 2), (3, 1, 1)}
    one = spark.createDataFrame([(None, 2, 1)], "f int, src long, dst long")
    assert {(r.f, r.id, r.label) for r in traj.connected_labels(nodes, one, ["f"]).collect()} == {(None, 1, 1), (None, 2, 1), (3, 1, 1)}
