"""Registered queries for profile models and fits."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumeflux.config import GAUSS_PARAMS
from plumeflux.fixtures import Inputs
from plumeflux.functions import models
from plumeflux.operators import fitting as ft
from plumeflux.plans.registry import query

KEY = ["transect_id"]
TRUE = "20e0 AS a0, 0.05e0 AS a1, 60e0 AS a2, CAST(transect_id%21-10 AS DOUBLE) AS a3, CAST(8+transect_id%15 AS DOUBLE) AS a4"


def true_fits(t: Inputs) -> DataFrame:
    g = F.col("transect_id")
    return t.sample.select(g).distinct().select(
        g,
        F.lit(20.0).alias("a0"),
        F.lit(0.05).alias("a1"),
        F.lit(60.0).alias("a2"),
        (g % 21 - 10).cast("double").alias("a3"),
        (8 + g % 15).cast("double").alias("a4"),
    )


def located(t: Inputs) -> DataFrame:
    x = F.col("dist_ortho")
    return t.sample.withColumns({"lon_ortho": -95.0 + 0.01 * x, "lat_ortho": 35.0 - 0.01 * x})


FITTED = f"""s AS (SELECT *, {TRUE}, -95e0+0.01e0*dist_ortho AS lon_ortho, 35e0-0.01e0*dist_ortho AS lat_ortho FROM fx_sample),
 f AS (SELECT *, a0+a1*dist_ortho+a2*exp(-4e0*ln(2e0)*power((dist_ortho-a3)/a4,2)) AS yf, a4/sqrt(8e0*ln(2e0)) AS sg FROM s)"""


@query(
    "d04_transect_coverage",
    f"""WITH {FITTED}, g AS (SELECT *, dist_ortho - lag(dist_ortho) OVER (PARTITION BY transect_id ORDER BY dist_ortho, event_id) AS gap FROM f)
    SELECT transect_id, round(max(gap)/(4*max(sg))*100,6) AS d_gap, round(((max(a3)-2*max(sg))-min(dist_ortho))/(4*max(sg))*100,6) AS d_left,
    round((max(dist_ortho)-(max(a3)+2*max(sg)))/(4*max(sg))*100,6) AS d_right, round(min(abs(dist_ortho-a3))/(4*max(sg))*100,6) AS d_center,
    count(*) AS nobs, count(*) FILTER (dist_ortho<a3) AS nobs_left, count(*) FILTER (dist_ortho>a3) AS nobs_right FROM g GROUP BY 1""",
    "fx_sample",
)
def d04(t: Inputs) -> DataFrame:
    m = ft.profile_metrics(located(t), true_fits(t), KEY)
    return m.select(
        *KEY, *[F.round(c, 6).alias(c) for c in ("d_gap", "d_left", "d_right", "d_center")], "nobs", "nobs_left", "nobs_right"
    )


@query(
    "d05_fit_error",
    f"""WITH {FITTED} SELECT transect_id, round(avg(abs(no2-yf)),6) AS mae, round(avg(abs(no2-yf)/greatest(abs(no2),2.220446049250313e-16)),6) AS mape,
    round(1-sum(power(no2-yf,2))/(var_pop(no2)*count(*)),6) AS rsq,
    round(1-sum(power(no2-yf,2))/(var_pop(no2-a0-a1*dist_ortho)*count(*)),6) AS rsq_detrend FROM f GROUP BY 1""",
    "fx_sample",
)
def d05(t: Inputs) -> DataFrame:
    m = ft.profile_metrics(t.sample, true_fits(t), KEY)
    return m.select(*KEY, *[F.round(c, 6).alias(c) for c in ("mae", "mape", "rsq", "rsq_detrend")])


@query(
    "h15_edge_positions",
    f"""WITH {FITTED} SELECT transect_id, round(arg_min(lon_ortho, abs(dist_ortho-a3)*1e6+dist_ortho*1e-3),6) AS lon_a3,
    round(arg_min(lat_ortho, abs(dist_ortho-(a3-a4/2))*1e6+dist_ortho*1e-3),6) AS lat_a3_i,
    round(arg_min(lon_ortho, abs(dist_ortho-(a3+a4/2))*1e6+dist_ortho*1e-3),6) AS lon_a3_f FROM f GROUP BY 1""",
    "fx_sample",
)
def h15(t: Inputs) -> DataFrame:
    m = ft.profile_metrics(located(t), true_fits(t), KEY)
    return m.select(*KEY, *[F.round(c, 6).alias(c) for c in ("lon_a3", "lat_a3_i", "lon_a3_f")])


@query(
    "h06_profile_models",
    f"""WITH {FITTED} SELECT event_id, round(yf,6) AS gauss,
    round(CASE WHEN dist_ortho>0 THEN 3e0*exp(-0.5e0*power(ln(dist_ortho/20e0)/0.7e0,2)) ELSE 0 END,6) AS pulse,
    round(5e0*exp(-abs(dist_ortho)/30e0),6) AS decay,
    round(0.5e0*sqrt(pi()/ln(2e0))*(a2/1e6*46.0055e0/1e6)*(a4*1e3)*abs(dist_ortho)*3600,6) AS flux FROM f""",
    "fx_sample",
)
def h06(t: Inputs) -> DataFrame:
    rows = t.sample.join(true_fits(t), KEY)
    return rows.select(
        "event_id",
        F.round(models.gaussian_bg("dist_ortho", *GAUSS_PARAMS), 6).alias("gauss"),
        F.round(models.lognormal_pulse("dist_ortho", 3.0, 20.0, 0.7), 6).alias("pulse"),
        F.round(models.exp_decay(F.abs("dist_ortho"), 5.0, 30.0), 6).alias("decay"),
        F.round(models.flux_no2("a2", "a4", F.abs("dist_ortho")), 6).alias("flux"),
    )


@query("i01_gaussian_fit")
def i01(t: Inputs) -> DataFrame:
    fits = ft.fit_gaussian(t.sample, KEY)
    return fits.select(*KEY, "fit_status", *[F.round(c, 4).alias(c) for c in (*GAUSS_PARAMS, "a2sig", "a4sig")])


@query(
    "i01_gaussian_fit_continuous",
    f"""SELECT transect_id, 'ok' AS fit_status, round(a0,2) AS a0, round(a1,2) AS a1, round(a2,2) AS a2, round(a3,2) AS a3, round(a4,2) AS a4
    FROM (SELECT DISTINCT transect_id, {TRUE} FROM fx_sample) t""",
    "fx_sample",
)
def i01c(t: Inputs) -> DataFrame:
    """The true profile of every transect at positions between those of the lattice."""
    rows = t.sample.join(true_fits(t), KEY).withColumn("x", F.col("dist_ortho") + F.col("event_id") % 7 * 0.031)
    rows = rows.select(*KEY, "x", models.gaussian_bg("x", *GAUSS_PARAMS).alias("no2"))
    fits = ft.fit_gaussian(rows, KEY, x="x")
    return fits.select(*KEY, "fit_status", *[(F.round(c, 2) + 0.0).alias(c) for c in GAUSS_PARAMS])


@query(
    "i01_gaussian_grid_fit",
    """WITH u AS (SELECT transect_id, dist_ortho AS x, count(*)::DOUBLE AS n, sum(no2) AS sy, sum(no2*no2) AS syy FROM fx_sample GROUP BY 1,2),
    e AS (SELECT u.*, CAST(c AS DOUBLE) AS a3, CAST(w AS DOUBLE) AS a4, exp(-4e0*ln(2e0)*power((x-c)/w,2)) AS g FROM u, range(-10,11) p(c), range(8,24,2) q(w)),
    s AS (SELECT transect_id, a3, a4, sum(n) AS sw, sum(n*x) AS sx, sum(n*x*x) AS sxx, sum(n*g) AS sg, sum(n*x*g) AS sxg, sum(n*g*g) AS sgg,
      sum(sy) AS sy, sum(sy*x) AS sxy, sum(sy*g) AS sgy, sum(syy) AS syy FROM e GROUP BY 1,2,3),
    d AS (SELECT *, sw*sxx-sx*sx AS det FROM s),
    b AS (SELECT *, (sw*sxg-sx*sg)/det AS b1, (sw*sxy-sx*sy)/det AS l1 FROM d WHERE det>0),
    k AS (SELECT *, (sg-b1*sx)/sw AS b0, (sy-l1*sx)/sw AS l0 FROM b),
    r AS (SELECT *, sgg-b0*sg-b1*sxg AS rgg, sgy-b0*sy-b1*sxy AS rgy FROM k),
    z AS (SELECT *, rgy/rgg AS a2, syy-l0*sy-l1*sxy-rgy/rgg*rgy AS sse FROM r WHERE rgg>1e-9),
    o AS (SELECT *, row_number() OVER (PARTITION BY transect_id ORDER BY sse, a3, a4) AS rn FROM z)
    SELECT transect_id, round(l0-a2*b0,5) AS a0, round(l1-a2*b1,5) AS a1, round(a2,5) AS a2, a3, a4, round(sse,3) AS sse FROM o WHERE rn=1""",
    "fx_sample",
)
def i01g(t: Inputs) -> DataFrame:
    best = ft.fit_gaussian_grid(t.sample, KEY, "dist_ortho", "no2", range(-10, 11), range(8, 24, 2))
    return best.select(*KEY, *[F.round(c, 5).alias(c) for c in ("a0", "a1", "a2")], "a3", "a4", F.round("sse", 3).alias("sse"))
