"""Band and nearest joins against brute force; edges of the hourly match; time zones."""

import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from plumeflux.functions import geo
from plumeflux.functions import timeconv as T
from plumeflux.operators import joins as jn


def test_geometry_properties(spark):
    rng = np.random.default_rng(1)
    pdf = pd.DataFrame({"a": rng.uniform(-89, 89, 300), "b": rng.uniform(-180, 180, 300), "c": rng.uniform(-89, 89, 300), "d": rng.uniform(-180, 180, 300), "x": rng.uniform(-2000, 2000, 300)})
    df = spark.createDataFrame(pdf)
    lat2, lon2 = geo.destination("a", "b", F.pmod(F.col("x"), F.lit(360.0)), F.lit(50.0))
    out = df.select(
        geo.haversine_m("a", "b", "c", "d").alias("ab"),
        geo.haversine_m("c", "d", "a", "b").alias("ba"),
        geo.bearing_deg("a", "b", "c", "d").alias("bear"),
        geo.wrap180("x").alias("w"),
        geo.haversine_m("a", "b", lat2, lon2).alias("moved"),
        "x",
    ).toPandas()
    assert np.allclose(out["ab"], out["ba"], rtol=1e-9)
    assert out["bear"].between(0, 360, inclusive="left").all()
    assert out["w"].between(-180, 180, inclusive="left").all()
    assert np.allclose((out["w"] - out["x"]) / 360, np.round((out["w"] - out["x"]) / 360))
    assert np.allclose(out["moved"], 50_000, rtol=1e-6)


def test_nearest_pixel_equals_brute_force(spark):
    rng = np.random.default_rng(2)
    px = pd.DataFrame({"s": rng.integers(0, 3, 500), "i": np.arange(500), "j": 0, "lat": rng.uniform(30, 31, 500), "lon": rng.uniform(-90, -89, 500)})
    px = pd.concat([px, px.assign(j=1)])  # exact copies: ties go to the lower index
    pt = pd.DataFrame({"s": rng.integers(0, 4, 200), "id": np.arange(200), "plat": rng.uniform(25, 36, 200), "plon": rng.uniform(-95, -84, 200)})
    pt.loc[:100, "plat"] = rng.uniform(30, 31, 101)
    pt.loc[:100, "plon"] = rng.uniform(-90, -89, 101)
    got = jn.nearest_pixel(spark.createDataFrame(pt), spark.createDataFrame(px), ["s"], ["id"], "plat", "plon").toPandas().set_index("id")
    for row in pt.itertuples():
        own = px[px["s"] == row.s]
        if own.empty:
            assert pd.isna(got.loc[row.id, "i"])
            continue
        d = (own["lat"] - row.plat) ** 2 + (own["lon"] - row.plon) ** 2
        assert got.loc[row.id, "i"] == own["i"].to_numpy()[np.argmin(d)] and got.loc[row.id, "j"] == 0


def test_within_radius_equals_brute_force(spark):
    rng = np.random.default_rng(4)
    px = pd.DataFrame({"s": rng.integers(0, 2, 300), "p": np.arange(300), "lat": rng.uniform(-0.3, 0.3, 300), "lon": rng.uniform(-0.3, 0.3, 300)})
    pt = pd.DataFrame({"s": rng.integers(0, 2, 100), "q": np.arange(100), "y": rng.uniform(-0.3, 0.3, 100), "x": rng.uniform(-0.3, 0.3, 100)})
    got = jn.within_radius(spark.createDataFrame(pt), spark.createDataFrame(px), ["s"], 0.07, "y", "x").select("p", "q").toPandas()
    both = pt.merge(px, on="s")
    want = both[(both["lat"] - both["y"]) ** 2 + (both["lon"] - both["x"]) ** 2 < 0.07**2]
    assert set(zip(got["p"], got["q"])) == set(zip(want["p"], want["q"])) and len(got) == len(want)


def test_asof_nearest_equals_brute_force_with_ties(spark):
    rng = np.random.default_rng(6)
    base = dt.datetime(2024, 1, 1)
    left = [(int(k % 3), int(k), base + dt.timedelta(minutes=int(m))) for k, m in enumerate(rng.integers(0, 20000, 120))]
    right = [(int(k % 2), int(k), base + dt.timedelta(minutes=int(m))) for k, m in enumerate(rng.integers(0, 2000, 60) * 10)]
    l = spark.createDataFrame(left, "g int, id long, lt timestamp")
    r = spark.createDataFrame(right, "g int, rid long, rt timestamp")
    got = {x["id"]: x["rid"] for x in jn.asof_nearest(l, r, ["g"], "lt", "rt", "id", "rid", ["rid"]).collect()}
    for g, k, t in left:
        pool = [(abs(t - rt), rid) for gg, rid, rt in right if gg == g]
        best = min(pool)[1] if pool else None
        assert got[k] == best


def test_hourly_match_edges(spark):
    h = lambda *a: dt.datetime(2024, 1, 1, *a)
    hourly = spark.createDataFrame([("a", h(10), 1.0), ("a", h(11), 2.0), ("a", h(14), 3.0)], "facility_id string, t timestamp, v double")
    rows = [(1, h(10, 30)), (2, h(11, 30)), (3, h(12, 30)), (4, h(13, 30)), (5, h(10, 30, 1)), (6, None), (7, h(9, 29, 59))]
    asks = spark.createDataFrame([("a", k, t) for k, t in rows], "facility_id string, id int, te timestamp")
    got = {r["id"]: r["v"] for r in jn.hourly_match(asks, hourly, ["facility_id"], "te", "t", "v", 0.5).collect()}
    assert got == {1: 1.0, 2: 2.0, 3: None, 4: 3.0, 5: 2.0, 6: None, 7: None}
    with pytest.raises(ValueError):
        jn.hourly_match(asks, hourly, ["facility_id"], "te", "t", "v", 2.0)


def test_dateline_box(spark):
    px = spark.createDataFrame([(1, 0.0, 179.5), (2, 0.0, -179.5), (3, 0.0, 170.0), (4, 5.0, 179.9)], "p int, lat double, lon double")
    fac = spark.createDataFrame([("f", 0.0, 179.0)], "facility_id string, lat double, lon double")
    assert {r["p"] for r in jn.box_join(px, fac, 2.0).collect()} == {1, 2}


def test_salted_box_join_equals_broadcast(spark, monkeypatch):
    rng = np.random.default_rng(8)
    px = spark.createDataFrame(pd.DataFrame({"p": np.arange(400), "lat": rng.uniform(-5, 5, 400), "lon": rng.uniform(-5, 5, 400)}))
    fac = spark.createDataFrame(pd.DataFrame({"facility_id": [str(k) for k in range(20)], "lat": rng.uniform(-5, 5, 20), "lon": rng.uniform(-5, 5, 20)}))
    want = {tuple(r) for r in jn.box_join(px, fac, 1.3).select("p", "facility_id").collect()}
    monkeypatch.setattr(jn, "broadcast_checked", lambda df: (df, False))
    got = [tuple(r) for r in jn.box_join(px, fac, 1.3).select("p", "facility_id").collect()]
    assert set(got) == want and len(got) == len(want) > 0


def test_local_hours_around_clock_changes(spark):
    rows = [
        (1, "2023-03-12 01:00:00", "America/Chicago", "2023-03-12 07:00:00"),
        (2, "2023-03-12 02:00:00", "America/Chicago", None),
        (3, "2023-03-12 03:00:00", "America/Chicago", "2023-03-12 08:00:00"),
        (4, "2023-11-05 00:00:00", "America/Chicago", "2023-11-05 05:00:00"),
        (5, "2023-11-05 01:00:00", "America/Chicago", None),
        (6, "2023-11-05 02:00:00", "America/Chicago", "2023-11-05 08:00:00"),
        (7, "2023-03-12 02:00:00", "America/Phoenix", "2023-03-12 09:00:00"),
    ]
    df = spark.createDataFrame([r[:3] for r in rows], "id int, l string, tz string")
    got = {r["id"]: r["u"] for r in df.select("id", F.date_format(T.local_to_utc(F.col("l").cast("timestamp"), "tz"), "yyyy-MM-dd HH:mm:ss").alias("u")).collect()}
    assert got == {r[0]: r[3] for r in rows}


def test_grid_interpolation_extrapolates_and_misses(spark):
    spec = jn.GridSpec(0.0, 1.0, 3, 10.0, 2.0, 4)
    t = dt.datetime(2024, 1, 1)
    cells = [(t, float(a), 10.0 + 2 * o, 3.0 * a - 0.5 * (10.0 + 2 * o)) for a in range(3) for o in range(4) if (a, o) != (2, 3)]
    grid = spark.createDataFrame(cells, "valid_time timestamp, lat double, lon double, f double")
    pts = spark.createDataFrame([(1, t, 0.3, 11.1), (2, t, -1.0, 9.0), (3, t, 1.5, 15.5), (4, None, 0.3, 11.1)], "id int, vt timestamp, lat double, lon double")
    got = {r["id"]: r["f"] for r in jn.grid_interp(pts, grid, spec, ["id"], "vt", ["f"]).collect()}
    assert got[1] == pytest.approx(0.9 - 5.55) and got[2] == pytest.approx(-3.0 - 4.5) and got[3] is None and got[4] is None


def test_far_points_meet_few_cells_at_every_level(spark):
    rng = np.random.default_rng(6)
    n = 40_000  # fills some 8,000 cells
    px = spark.createDataFrame(pd.DataFrame({"s": 1, "lat": rng.uniform(30, 39, n), "lon": rng.uniform(-90, -81, n)}))
    rows = px.withColumns({"c0": jn.cell("lat", 0.1), "c1": jn.cell("lon", 0.1)})
    levels = jn.occupied_levels(rows, ["s"], ["c0", "c1"], ["lat", "lon"], 0.1, 360.0)
    assert levels[0].count() > 7_500 and levels[-1].count() <= 4
    angle, d = rng.uniform(0, 2 * np.pi, 300), rng.uniform(8, 60, 300)
    pt = pd.DataFrame({"s": 1, "id": np.arange(300), "__l0": 34.5 + d * np.sin(angle), "__l1": -85.5 + d * np.cos(angle)})
    steps = jn.coarse_to_fine(spark.createDataFrame(pt), levels, ["s"], ["s", "id"], ["c0", "c1"])
    most = [s.groupBy("id").count().agg({"count": "max"}).first()[0] for s in steps]
    mean = [s.count() / 300 for s in steps]
    assert len(steps) == len(levels) and max(most) <= 120 and max(mean) <= 40


def test_clip_moves_no_pixels_while_rectangles_are_small(spark, monkeypatch, capsys):
    from plumeflux.plans import jobs

    rng = np.random.default_rng(9)
    px = pd.DataFrame([(f"g{g}", i, j) for g in range(4) for i in range(20) for j in range(20)], columns=["granule_id", "i", "j"])
    px = px.assign(lat=30 + 0.3 * px["i"] + rng.uniform(0, 0.1, len(px)), lon=-90 + 0.3 * px["j"], no2=1.0, t_utc=dt.datetime(2024, 1, 1))
    pixels = spark.createDataFrame(px)
    fac = spark.createDataFrame([("a", 32.0, -88.0), ("b", 34.0, -86.5), ("far", -60.0, 10.0)], "facility_id string, lat double, lon double")
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:

        def clip():
            clipped = jobs.clip_granules(pixels, jobs.granule_extents(pixels), fac)[1]
            clipped.explain("simple")
            return capsys.readouterr().out, sorted(map(tuple, clipped.select("facility_id", "granule_id", "i", "j").collect()))

        plan, small = clip()
        assert "SortMergeJoin" not in plan and plan.count("BroadcastHashJoin") == 2
        monkeypatch.setattr(jobs, "broadcast_checked", lambda df: (df, False))
        plan, large = clip()
        assert "BroadcastHashJoin" not in plan
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    assert small == large and {r[0] for r in small} == {"a", "b"}
