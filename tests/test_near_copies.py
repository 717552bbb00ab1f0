"""Points reach everything within the size from few cells, and the closest row stays the closest."""

import numpy as np
import pandas as pd

from plumeflux.operators import joins as jn


def test_two_cells_per_coordinate(spark):
    rng = np.random.default_rng(2)
    points = pd.DataFrame(rng.uniform(-3, 3, (400, 3)), columns=["__l0", "__l1", "__l2"]).assign(p=range(400))
    for n in (1, 2, 3):
        cells = [f"__c{k}" for k in range(n)]
        copies = jn.in_reach(spark.createDataFrame(points), cells, 0.1).toPandas()
        assert len(copies) <= 1.01 * 2**n * len(points)
        inside = np.ones(len(copies), bool)
        for k in range(n):  # a place within the size lies in one of the cells
            other = copies[f"__l{k}"] + 0.1 * np.cos(copies["p"] + k)
            inside &= np.floor(other / 0.2) == copies[f"__c{k}"]
        assert copies[inside].groupby("p").size().eq(1).all() and copies[inside]["p"].nunique() == 400


def test_same_as_all_pairs(spark):
    rng = np.random.default_rng(8)
    px = pd.DataFrame([(s, i, j) for s in (0, 1) for i in range(9) for j in range(9)], columns=["scene", "i", "j"])
    px = px.assign(lat=0.1 * px["i"], lon=0.1 * px["j"])
    points = pd.DataFrame({"p": range(300), "scene": rng.integers(0, 2, 300), "y": rng.integers(-8, 24, 300) * 0.05, "x": rng.integers(-8, 24, 300) * 0.05})
    got = jn.nearest_pixel(spark.createDataFrame(points), spark.createDataFrame(px), ["scene"], ["p"], "y", "x").toPandas().set_index("p")
    both = points.merge(px, on="scene")
    both["d2"] = (both["y"] - both["lat"]) ** 2 + (both["x"] - both["lon"]) ** 2
    want = both.sort_values(["p", "d2", "i", "j"]).drop_duplicates("p").set_index("p")
    assert len(got) == 300 and (got[["i", "j"]].astype(int) == want.loc[got.index, ["i", "j"]]).all().all()
