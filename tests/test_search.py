"""Random search with halving."""

import numpy as np
import pandas as pd

from hemolens.operators import models


def test_drawn_settings_lie_in_the_ranges_and_repeat():
    drawn = models.drawn_settings(300, 7)
    assert drawn == models.drawn_settings(300, 7) != models.drawn_settings(300, 8)
    assert {s["depth"] for s in drawn} == {3, 4, 5, 6, 7, 8}
    assert all(0.01 <= s["rate"] <= 0.1 and 100 <= s["trees"] <= 500 for s in drawn)
    assert 0.4 < np.mean([s["rate"] < 0.0316 for s in drawn]) < 0.6


def test_halving_keeps_the_better_settings_and_stops_early(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(500, 2))
    y = ((x[:, 0] * x[:, 1] > 0) ^ (rng.random(500) < 0.05)).astype(int)
    df = spark.createDataFrame(pd.DataFrame({"i": np.arange(500), "a": x[:, 0], "b": x[:, 1], "y": y}))
    settings = [{"depth": 1, "rate": 0.01, "trees": 60}, {"depth": 3, "rate": 0.3, "trees": 60}, {"depth": 1, "rate": 0.02, "trees": 60}]
    model, trail = models.search_boosted(df, ["a", "b"], "y", "i", settings=settings, first_trees=4)
    rows = trail.collect()
    assert [(r["round"], r.draw) for r in rows][:3] == [(1, 0), (1, 1), (1, 2)] and [r["round"] for r in rows] == [1, 1, 1, 2, 2, 3]
    last = rows[-1]
    assert last.chosen and last.draw == 1 and last.grown <= last.trees == 60 and last.score > 0.9
    assert model.stages[-1].getNumTrees == last.grown and last.grown < 60
    number = df.selectExpr("i", "a", "b", "a * 2.0 + y AS z")
    _, trail = models.search_boosted(number, ["a", "b"], "z", "i", task="number", settings=settings[:2], first_trees=4)
    rows = trail.collect()
    assert rows[-1].draw == 1 and rows[1].score < rows[0].score
