"""Segmented series, order statistics and salted joins against plain references."""

import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import Window
from pyspark.sql import functions as F

from plumeflux.operators.scale import dealt, exact_quantiles, heavy_keys, median_mad, order_stats, salted_lookup
from plumeflux.operators.series import SEG, halo_segments, with_series

FEATURES = dict(
    row_number="rn",
    lag={"lg": "v"},
    lead={"ld": "v"},
    running={"rs": "w"},
    first={"fi": "v"},
    last={"la": "v"},
    ffill={"ff": "v"},
    bfill={"bf": "v"},
    overall={"mx": "w"},
)


@pytest.fixture(scope="module")
def skewed(spark):
    rng = np.random.default_rng(7)
    n = 3000
    pdf = pd.DataFrame(
        {
            "g": np.where(rng.random(n) < 0.4, 0, rng.integers(1, 40, n)),
            "t": rng.permutation(n),
            "w": rng.integers(0, 100, n),
        }
    )
    pdf["v"] = pd.array(np.where(rng.random(n) < 0.3, None, rng.integers(0, 1000, n)), dtype="Int64")
    return spark.createDataFrame(pdf)


def test_segmented_series_equals_plain(skewed):
    plain = with_series(skewed, ["g"], ["t"], **FEATURES).toPandas()
    cut = with_series(skewed, ["g"], ["t"], segment=F.floor(F.col("t") / 37), **FEATURES).toPandas()
    order = list(plain.columns)
    a, b = (d[order].sort_values(["g", "t"]).reset_index(drop=True) for d in (plain, cut))
    pd.testing.assert_frame_equal(a, b, check_dtype=False)


def test_halo_windows_see_neighbours_across_cuts(spark):
    df = spark.range(0, 100).select(F.lit(1).alias("g"), F.col("id").alias("step_id"))
    w = Window.partitionBy("g", SEG).orderBy("step_id")
    near = halo_segments(df, width=8, halo=2).withColumns({"a": F.lag("step_id", 2).over(w), "b": F.lead("step_id", 2).over(w)})
    rows = near.where("__core").orderBy("step_id").toPandas()
    assert rows["step_id"].tolist() == list(range(100))
    assert rows["a"][2:].tolist() == list(range(98)) and rows["b"][:98].tolist() == list(range(2, 100))


def test_exact_quantiles_match_numpy(spark):
    rng = np.random.default_rng(3)
    groups = {0: rng.normal(0, 1e-3, 4000), 1: rng.lognormal(0, 4, 101), 2: np.array([5.0]), 3: np.repeat([1.0, -2.0, 0.0], 50)}
    pdf = pd.concat([pd.DataFrame({"g": k, "v": v}) for k, v in groups.items()])
    pdf = pd.concat([pdf, pd.DataFrame({"g": [0, 1], "v": [np.nan, np.nan]})])
    probs = {"lo": 0.02, "mid": 0.5, "hi": 0.98, "top": 1.0, "bottom": 0.0}
    got = exact_quantiles(spark.createDataFrame(pdf), ["g"], "v", probs).toPandas().set_index("g")
    for g, values in groups.items():
        assert got.loc[g, "n"] == len(values)
        for name, p in probs.items():
            assert got.loc[g, name] == pytest.approx(np.quantile(values, p), rel=1e-12, abs=1e-15)


def test_order_statistics_and_mad(spark):
    v = np.random.default_rng(5).normal(10, 3, 777)
    df = spark.createDataFrame(pd.DataFrame({"g": 1, "v": v}))
    row = order_stats(df, ["g"], "v", {"first": lambda n: F.lit(0), "beyond": lambda n: n, "third": lambda n: F.lit(2)}).first()
    assert row["first"] == v.min() and row["beyond"] is None and row["third"] == np.sort(v)[2]
    mm = median_mad(df, ["g"], "v").first()
    assert mm["median"] == pytest.approx(np.median(v)) and mm["mad"] == pytest.approx(np.median(np.abs(v - np.median(v))))
    overall = exact_quantiles(df, [], "v", {"q": 0.25}).first()
    assert overall["q"] == pytest.approx(np.quantile(v, 0.25))


def test_salted_lookup_keeps_every_row(skewed, spark):
    small = spark.createDataFrame([(0, "hot"), (1, "one")], "g long, tag string")
    out = salted_lookup(skewed, small, ["g"])
    assert out.count() == skewed.count()
    assert out.where("g = 0 AND tag <> 'hot'").count() == 0 and out.where("g > 1 AND tag IS NOT NULL").count() == 0


@settings(max_examples=15, deadline=None)
@given(st.lists(st.floats(-1e6, 1e6, allow_nan=False), min_size=1, max_size=40), st.sampled_from([0.0, 0.1, 0.5, 0.75, 1.0]))
def test_quantile_property(spark, values, p):
    df = spark.createDataFrame([(float(v),) for v in values], "v double")
    assert exact_quantiles(df, [], "v", {"q": p}).first()["q"] == pytest.approx(np.quantile(values, p), rel=1e-9, abs=1e-9)


def test_order_stats_with_infinities(spark):
    inf = float("inf")
    df = spark.createDataFrame([("a", v) for v in (-inf, 1.0, 2.0, 3.0, inf)] + [("b", inf)], "k string, v double")
    got = {r.k: (r.n, r.lo, r.mid, r.hi) for r in exact_quantiles_ranks(df)}
    assert got == {"a": (5, -inf, 2.0, inf), "b": (1, inf, inf, inf)}


def exact_quantiles_ranks(df):
    from plumeflux.operators.scale import order_stats

    ranks = {"lo": lambda n: n * 0, "mid": lambda n: (n - 1) / 2, "hi": lambda n: n - 1}
    return order_stats(df, ["k"], "v", ranks).collect()


def test_a_million_values_in_one_bucket_are_refined(spark):
    """All values share the first bucket; no task orders more than a share of them, and a hot tie stays right."""
    n = 1_000_000
    close = F.lit(1.0) + F.col("id") * F.lit(2.0**-42)  # 2**-22 in all, far below a bucket's width
    df = spark.range(n).select((F.col("id") % 2).alias("g"), close.alias("x")).unionByName(spark.range(400_000).select(F.lit(2).cast("long").alias("g"), F.lit(5.0).alias("x")))
    ranks = {"low": lambda n: F.lit(0), "mid": lambda n: F.floor(n / 3), "top": lambda n: n - 1}
    got = {r.g: r for r in order_stats(df, ["g"], "x", ranks, task_rows=1000).collect()}
    for g in (0, 1):
        at = [0, n // 6, n // 2 - 1]
        assert [got[g].low, got[g].mid, got[g].top] == [1.0 + (2 * k + g) * 2.0**-42 for k in at] and got[g].n == n // 2
    assert [got[2].low, got[2].mid, got[2].top] == [5.0] * 3
    whole = order_stats(df, [], "x", {"mid": lambda n: F.floor(n / 2)}, task_rows=1000).first()
    assert whole.mid == 1.0 + 700_000 * 2.0**-42


@pytest.mark.parametrize("task_rows", [1, 50])
def test_refined_ranks_match_sorted_values(spark, task_rows):
    rng = np.random.default_rng(12)
    pdf = pd.DataFrame({"g": rng.integers(0, 3, 4000), "x": np.concatenate([rng.normal(0, 1e-3, 1500) + 7, np.repeat([7.0, -0.0, 0.0, np.inf, -np.inf], 200), rng.normal(0, 50, 1500)])})
    got = order_stats(spark.createDataFrame(pdf), ["g"], "x", {f"r{k}": (lambda n, k=k: F.floor(n * k / 10)) for k in range(10)}, task_rows).toPandas().set_index("g")
    for g, own in pdf.groupby("g"):
        values = np.sort(own["x"].to_numpy())
        assert [got.loc[g, f"r{k}"] for k in range(10)] == [values[len(values) * k // 10] for k in range(10)]


@pytest.mark.parametrize("parts", [12, 200])
def test_heavy_keys_get_salts_by_their_share(spark, parts):
    """A key with a third of the rows, one with a tenth, null keys and 20,000 light ones: no task gets much over an even share."""
    n = 300_000
    key = F.when(F.col("id") % 3 == 0, -1).when(F.col("id") % 10 == 1, -2).when(F.col("id") % 10 == 2, None).otherwise(F.col("id") % 20_000)
    big = spark.range(n).select(key.alias("k"), "id")
    small = big.where("k IS NOT NULL").select("k").distinct().withColumn("v", F.col("k") * 2)
    rows, copies = dealt(big, small, ["k"], ["id"], parts=parts)
    assert rows.groupBy("k", "__salt").count().agg(F.max("count")).first()[0] < 2.5 * n / parts
    heavy = heavy_keys(big, ["k"], parts)
    assert len(heavy) == {12: 1, 200: 3}[parts] and copies.count() <= small.count() + sum(heavy.values())
    got = rows.join(copies, ["k", "__salt"], "left")
    assert got.count() == n and got.where("NOT v <=> k * 2").isEmpty()


def test_gaps_of_a_million_positions(spark):
    """One transect with 10**6 positions over 200 km, one with a few, one with a single position."""
    from plumeflux.operators.fitting import profile_metrics

    far = F.when(F.col("id") >= 700_000, 3.25).otherwise(0.0)
    many = spark.range(1_000_000).select(F.lit(1).alias("k"), (-100.0 + F.col("id") * F.lit(200 / 2**20) + far).alias("dist_ortho"))
    few = spark.createDataFrame([(2, -7.5), (2, -7.5), (2, -7.25), (2, 0.0), (2, 0.5), (3, 4.0)], "k int, dist_ortho double")
    samples = many.unionByName(few).withColumn("no2", F.lit(1.0) + F.pmod("dist_ortho", F.lit(3)))
    fits = spark.createDataFrame([(k, 1.0, 0.0, 5.0, 0.0, 10.0) for k in (1, 2, 3)], "k int, a0 double, a1 double, a2 double, a3 double, a4 double")
    got = {r.k: r for r in profile_metrics(samples, fits, ["k"]).collect()}
    pct = 100 / (4 * 10 / (2 * np.sqrt(2 * np.log(2))))
    assert [got[k].d_gap / pct for k in (1, 2, 3)] == pytest.approx([3.25 + 200 / 2**20, 7.25, 0.0]) and got[1].nobs == 1_000_000
