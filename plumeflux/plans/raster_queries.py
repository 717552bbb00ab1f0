"""Registered queries for raster operators and optimised paths."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumeflux.fixtures import Inputs
from plumeflux.operators import paths as pt
from plumeflux.operators import raster as rs
from plumeflux.operators import spine as sp
from plumeflux.operators.joins import nearest_path_row
from plumeflux.plans.registry import query
from plumeflux.plans.series_queries import NEAR, W, bear, hav
from plumeflux.session import cut_lineage

KEY = ["scene"]

SNR = """nb AS (SELECT scene, i+a AS i, j+b AS j, no2, no2_sigma FROM fx_pixel, range(-1,2) x(a), range(-1,2) y(b)),
 bgd AS (SELECT scene, median(no2) AS bg, quantile_cont(no2,0.75)-quantile_cont(no2,0.25) AS iqr, max(i) AS im, max(j) AS jm FROM fx_pixel GROUP BY 1),
 snr AS (SELECT scene, i, j, (avg(no2)-max(bg))/sqrt(sum(no2_sigma*no2_sigma)/(count(*)*count(*))+max(iqr)*max(iqr)) AS snr
  FROM nb JOIN bgd USING (scene) WHERE i>=1 AND i<im AND j>=1 AND j<jm GROUP BY 1,2,3 HAVING count(*)>=6),
 thr AS (SELECT scene, quantile_cont(snr,0.75) AS t FROM snr GROUP BY 1)"""


def scene_seeds(t: Inputs) -> DataFrame:
    s = F.col("scene")
    return t.pixel.select("scene").distinct().select(s, ((s * 7) % 50).alias("i"), ((s * 11) % 64).alias("j"))


@query("j01_focal_snr", f"WITH {SNR} SELECT scene, i, j, round(snr,6) AS snr FROM snr", "fx_pixel")
def j01(t: Inputs) -> DataFrame:
    return rs.focal_snr(t.pixel, KEY).select("scene", "i", "j", F.round("snr", 6).alias("snr"))


@query("d09_snr_threshold", f"WITH {SNR} SELECT scene, round(t,6) AS snr_critical FROM thr", "fx_pixel")
def d09(t: Inputs) -> DataFrame:
    thr = rs.snr_threshold(cut_lineage(rs.focal_snr(t.pixel, KEY)), KEY)
    return thr.select("scene", F.round("snr_critical", 6).alias("snr_critical"))


MASK = f"""{SNR}, seed AS (SELECT DISTINCT scene, (scene*7)%50 AS i, (scene*11)%64 AS j FROM fx_pixel),
 cand AS (SELECT snr.scene, i, j FROM snr JOIN thr USING (scene) WHERE snr>=t UNION SELECT * FROM seed),
 mask AS (SELECT scene, i, j FROM seed UNION SELECT c.scene, c.i, c.j FROM mask m JOIN cand c ON c.scene=m.scene AND abs(c.i-m.i)<=1 AND abs(c.j-m.j)<=1)"""


def scene_mask(t: Inputs, tile: int = rs.TILE) -> DataFrame:
    return rs.plume_mask(cut_lineage(rs.focal_snr(t.pixel, KEY)), scene_seeds(t), KEY, tile=tile)


@query("j02_plume_mask", f"WITH RECURSIVE {MASK} SELECT scene, i, j FROM mask", "fx_pixel")
def j02(t: Inputs) -> DataFrame:
    return scene_mask(t)


@query(
    "j03_mask_from_nearest_pixel",
    f"""WITH RECURSIVE {SNR}, near AS (SELECT scene, i, j, row_number() OVER (PARTITION BY scene ORDER BY power(lon+94e0,2)+power(lat-36.02e0,2), i, j) AS rn FROM fx_pixel),
    seed AS (SELECT scene, i, j FROM near WHERE rn=1),
    cand AS (SELECT snr.scene, i, j FROM snr JOIN thr USING (scene) WHERE snr>=t UNION SELECT * FROM seed),
    mask AS (SELECT scene, i, j FROM seed UNION SELECT c.scene, c.i, c.j FROM mask m JOIN cand c ON c.scene=m.scene AND abs(c.i-m.i)<=1 AND abs(c.j-m.j)<=1)
    SELECT scene, i, j FROM mask""",
    "fx_pixel",
)
def j03(t: Inputs) -> DataFrame:
    from plumeflux.operators.joins import nearest_pixel

    at = t.pixel.select("scene").distinct().select("scene", F.lit(36.02).alias("flat"), F.lit(-94.0).alias("flon"))
    seeds = nearest_pixel(at, t.pixel, KEY, KEY, "flat", "flon").select("scene", "i", "j")
    return rs.plume_mask(cut_lineage(rs.focal_snr(t.pixel, KEY)), seeds, KEY)


@query(
    "j08_mask_pixels",
    f"WITH RECURSIVE {MASK} SELECT p.scene, p.i, p.j, round(p.lat,6) AS lat, round(p.lon,6) AS lon FROM fx_pixel p JOIN mask USING (scene, i, j)",
    "fx_pixel",
)
def j08(t: Inputs) -> DataFrame:
    rows = rs.mask_pixels(scene_mask(t), t.pixel, KEY)
    return rows.select("scene", "i", "j", F.round("lat", 6).alias("lat"), F.round("lon", 6).alias("lon"))


def scene_spine(t: Inputs) -> DataFrame:
    """Spine through the plume mask of each scene, from its seed."""
    plume = rs.mask_pixels(cut_lineage(scene_mask(t)), t.pixel, KEY)
    return sp.least_cost_spine(plume, scene_seeds(t), KEY)


#: Cheapest costs by relaxing every cell that got cheaper, then the way back from the farthest cell over the cheapest, lowest neighbour.
SPINE = f"""{MASK}, plume AS MATERIALIZED (SELECT p.scene, p.i, p.j, p.no2, p.lat, p.lon FROM fx_pixel p JOIN mask USING (scene, i, j)),
 origin AS (SELECT scene, coalesce(max({{'i': p.i, 'j': p.j}}) FILTER (p.i=(scene*7)%50 AND p.j=(scene*11)%64), min({{'i': p.i, 'j': p.j}})) AS o FROM plume p GROUP BY scene),
 source AS (SELECT p.* FROM plume p JOIN origin g ON p.scene=g.scene AND p.i=g.o.i AND p.j=g.o.j),
 dist(scene, i, j, no2, cost) USING KEY (scene, i, j) AS (SELECT scene, i, j, no2, 0e0 FROM source
  UNION SELECT q.scene, q.i, q.j, q.no2, min(d.cost+1e0/(0.5e0*(d.no2+q.no2)+1e-9)) AS cost FROM dist d
   JOIN plume q ON q.scene=d.scene AND abs(q.i-d.i)<=1 AND abs(q.j-d.j)<=1 AND (q.i<>d.i OR q.j<>d.j) AND 0.5e0*(d.no2+q.no2)+1e-9>0
   LEFT JOIN recurring.dist r ON r.scene=q.scene AND r.i=q.i AND r.j=q.j
   WHERE r.cost IS NULL OR d.cost+1e0/(0.5e0*(d.no2+q.no2)+1e-9)<r.cost GROUP BY q.scene, q.i, q.j, q.no2),
 reached AS MATERIALIZED (SELECT d.*, p.lat, p.lon FROM dist d JOIN plume p USING (scene, i, j)),
 ends AS (SELECT r.scene, r.i, r.j, row_number() OVER (PARTITION BY r.scene ORDER BY round({hav('s.lat','s.lon','r.lat','r.lon')},3) DESC, r.i, r.j) AS rn
  FROM reached r JOIN source s ON r.scene=s.scene),
 back AS (SELECT scene, i, j, 0 AS n FROM ends WHERE rn=1
  UNION ALL SELECT scene, b.i, b.j, n+1 FROM (SELECT k.scene, k.n, arg_min({{'i': q.i, 'j': q.j}}, {{'c': q.cost+1e0/(0.5e0*(m.no2+q.no2)+1e-9), 'i': q.i, 'j': q.j}}) AS b
   FROM back k JOIN reached m ON m.scene=k.scene AND m.i=k.i AND m.j=k.j AND m.cost>0
   JOIN reached q ON q.scene=k.scene AND abs(q.i-k.i)<=1 AND abs(q.j-k.j)<=1 AND (q.i<>k.i OR q.j<>k.j) AND 0.5e0*(m.no2+q.no2)+1e-9>0 GROUP BY k.scene, k.n)),
 spine AS (SELECT scene, i, j, lat, lon, max(n) OVER (PARTITION BY scene)-n AS step_id, count(*) OVER (PARTITION BY scene) AS cells FROM back JOIN reached USING (scene, i, j))"""


@query("j04_least_cost_spine", f"WITH RECURSIVE {SPINE} SELECT scene, CAST(step_id AS BIGINT) AS step_id, i, j FROM spine WHERE cells>=2", "fx_pixel")
def j04(t: Inputs) -> DataFrame:
    return scene_spine(t).select("scene", "step_id", "i", "j")


def scene_clock(t: Inputs) -> DataFrame:
    """A trajectory per scene: 15-minute steps along all of its rows, to and fro."""
    step = F.col("i") * 64 + F.when(F.col("i") % 2 == 0, F.col("j")).otherwise(63 - F.col("j"))
    return t.pixel.select(
        "scene",
        step.alias("step_id"),
        F.timestamp_micros(F.lit(1704067200000000) + step * 900000000).alias("tstmp"),
        "lat",
        "lon",
        (4.0 + F.col("j") % 3).alias("wso"),
        F.expr("TIMESTAMP '2024-01-01 18:00:00'").alias("t_overpass"),
    )


def _less(q: str, *polys: str) -> str:
    """SQL: q less its parts along earlier polynomials of the path, all orthogonal sums over its points."""
    return f"{q}-avg({q}) OVER f" + "".join(f"-sum({q}*{p}) OVER f/sum({p}*{p}) OVER f*{p}" for p in polys)


def _fitted(c: str) -> str:
    return f"avg({c}) OVER f" + "".join(f"+sum({c}*{p}) OVER f/sum({p}*{p}) OVER f*{p}" for p in ("p1", "p2", "p3"))


@query(
    "i06_polynomial_smoothing",
    f"""WITH {NEAR}, a AS (SELECT facility_id, step_id, lat, lon, sum(coalesce({hav('plat','plon','lat','lon')},0e0)) OVER {W}/1000e0 AS age FROM near),
    t AS (SELECT *, (age-min(age) OVER f)/(max(age) OVER f-min(age) OVER f+1e-9) AS t, count(*) OVER f AS n FROM a WINDOW f AS (PARTITION BY facility_id)),
    o1 AS (SELECT *, {_less('t')} AS p1 FROM t WINDOW f AS (PARTITION BY facility_id)),
    q2 AS (SELECT *, t*p1 AS q FROM o1), o2 AS (SELECT * EXCLUDE (q), {_less('q', 'p1')} AS p2 FROM q2 WINDOW f AS (PARTITION BY facility_id)),
    q3 AS (SELECT *, t*p2 AS q FROM o2), o3 AS (SELECT * EXCLUDE (q), {_less('q', 'p1', 'p2')} AS p3 FROM q3 WINDOW f AS (PARTITION BY facility_id))
    SELECT facility_id, step_id, round(CASE WHEN n>=4 THEN {_fitted('lat')} ELSE lat END,6) AS lat,
    round(CASE WHEN n>=4 THEN {_fitted('lon')} ELSE lon END,6) AS lon FROM o3 WINDOW f AS (PARTITION BY facility_id)""",
    "fx_trajectory",
)
def i06(t: Inputs) -> DataFrame:
    from plumeflux.operators.trajectory import cumulative_distance

    path = cumulative_distance(t.trajectory, ["facility_id"]).select("facility_id", "step_id", "lat", "lon", "age_km")
    out = pt.smooth_path(path, ["facility_id"], 3)
    return out.select("facility_id", "step_id", F.round("lat", 6).alias("lat"), F.round("lon", 6).alias("lon"))


#: Smoothed by cubic polynomials in normalised distance, as ``i06_polynomial_smoothing``; steps of 900 s.
TRAJECTORY = f"""{SPINE}, leg0 AS (SELECT *, lag(lat) OVER s AS plat, lag(lon) OVER s AS plon FROM spine WHERE cells>=2 WINDOW s AS (PARTITION BY scene ORDER BY step_id)),
 far0 AS (SELECT scene, step_id, lat, lon, sum(coalesce({hav('plat','plon','lat','lon')},0e0)) OVER (PARTITION BY scene ORDER BY step_id)/1000e0 AS age FROM leg0),
 t AS (SELECT *, (age-min(age) OVER f)/(max(age) OVER f-min(age) OVER f+1e-9) AS t, count(*) OVER f AS n FROM far0 WINDOW f AS (PARTITION BY scene)),
 o1 AS (SELECT *, {_less('t')} AS p1 FROM t WINDOW f AS (PARTITION BY scene)),
 q2 AS (SELECT *, t*p1 AS q FROM o1), o2 AS (SELECT * EXCLUDE (q), {_less('q', 'p1')} AS p2 FROM q2 WINDOW f AS (PARTITION BY scene)),
 q3 AS (SELECT *, t*p2 AS q FROM o2), o3 AS (SELECT * EXCLUDE (q), {_less('q', 'p1', 'p2')} AS p3 FROM q3 WINDOW f AS (PARTITION BY scene)),
 smooth AS (SELECT scene, step_id, n>=4 AS smoothed, CASE WHEN n>=4 THEN {_fitted('lat')} ELSE lat END AS lat, CASE WHEN n>=4 THEN {_fitted('lon')} ELSE lon END AS lon
  FROM o3 WINDOW f AS (PARTITION BY scene)),
 near AS (SELECT *, lag(lat) OVER s AS plat, lag(lon) OVER s AS plon, lead(lat) OVER s AS nlat, lead(lon) OVER s AS nlon, first_value(lat) OVER s AS lat0, first_value(lon) OVER s AS lon0
  FROM smooth WINDOW s AS (PARTITION BY scene ORDER BY step_id)),
 legs AS (SELECT *, sum(coalesce({hav('plat','plon','lat','lon')},0e0)) OVER (PARTITION BY scene ORDER BY step_id)/1000e0 AS age, {hav('lat','lon','nlat','nlon')}/900e0 AS speed FROM near),
 winds AS (SELECT scene, avg(4e0+j%3) AS mean FROM fx_pixel GROUP BY scene)"""


@query(
    "j05_spine_to_trajectory",
    f"""WITH RECURSIVE {TRAJECTORY} SELECT scene, CAST(step_id AS BIGINT) AS step_id, round(lat,6) AS lat, round(lon,6) AS lon, round(age,6) AS age_km, round(age/(mean*3.6e0+1e-9),6) AS age_hours,
    round(coalesce(CASE WHEN smoothed THEN speed END, mean),6) AS wso,
    round(CASE WHEN step_id=0 THEN {bear('lat','lon','nlat','nlon')} ELSE {bear('lat0','lon0','lat','lon')} END,6) AS wd FROM legs JOIN winds USING (scene)""",
    "fx_pixel",
)
def j05(t: Inputs) -> DataFrame:
    path = pt.spine_to_trajectory(cut_lineage(scene_spine(t)), scene_clock(t), KEY)
    return path.select(
        "scene", "step_id", *[F.round(c, 6).alias(c) for c in ("lat", "lon", "age_km", "age_hours", "wso", "wd")]
    )


@query(
    "j06_peak_chain",
    f"""WITH c AS (SELECT facility_id, step_id AS source_step, lat+0.01e0 AS lat, lon-0.01e0 AS lon,
      row_number() OVER {W}-1 AS step_id, count(*) OVER (PARTITION BY facility_id) AS n FROM fx_trajectory WHERE step_id%4<>0),
    k AS (SELECT facility_id, floor((epoch_us(max(tstmp) FILTER (step_id=1))-epoch_us(max(tstmp) FILTER (step_id=0)))/1e6) AS dt FROM fx_trajectory GROUP BY 1),
    l AS (SELECT *, lag(lat) OVER {W} AS plat, lag(lon) OVER {W} AS plon, lead(lat) OVER {W} AS nlat, lead(lon) OVER {W} AS nlon,
      first_value(lat) OVER {W} AS lat0, first_value(lon) OVER {W} AS lon0 FROM c WHERE n>=2),
    g AS (SELECT *, coalesce({hav('plat','plon','lat','lon')},0e0) AS back, {hav('lat','lon','nlat','nlon')} AS leg FROM l)
    SELECT facility_id, step_id, source_step, round(sum(back) OVER {W}/1000e0,5) AS age_km,
    round(CASE WHEN dt>0 THEN coalesce(leg, back)/dt END,5) AS wso,
    round(CASE WHEN step_id=0 THEN {bear('lat','lon','nlat','nlon')} ELSE {bear('lat0','lon0','lat','lon')} END,5) AS wd FROM g JOIN k USING (facility_id)""",
    "fx_trajectory",
)
def j06(t: Inputs) -> DataFrame:
    csf = t.trajectory.select(
        "facility_id",
        "step_id",
        F.when(F.col("step_id") % 4 != 0, F.col("lat") + 0.01).alias("lat_a3"),
        (F.col("lon") - 0.01).alias("lon_a3"),
    )
    chain = pt.peak_chain(csf, t.trajectory.withColumn("wso", F.lit(5.0)), ["facility_id"])
    return chain.select("facility_id", "step_id", "source_step", *[F.round(c, 5).alias(c) for c in ("age_km", "wso", "wd")])


@query(
    "j07_greedy_walk",
    f"""WITH RECURSIVE lv AS (SELECT scene, median(no2)+0.5e0*(quantile_cont(no2,0.75)-quantile_cont(no2,0.25)) AS low FROM fx_pixel GROUP BY 1),
    seed AS (SELECT DISTINCT scene, (scene*7)%50 AS i, (scene*11)%64 AS j FROM fx_pixel),
    walk AS (SELECT s.scene, s.i, s.j, 0 AS way, [s.i*1000000+s.j] AS seen FROM seed s JOIN fx_pixel p ON p.scene=s.scene AND p.i=s.i AND p.j=s.j
     UNION ALL SELECT scene, b.i, b.j, way+1, list_append(seen, b.i*1000000+b.j) FROM (
      SELECT w.scene, w.way, w.seen, arg_max({{'i': p.i, 'j': p.j}}, {{'v': p.no2, 'a': -p.i, 'b': -p.j}}) AS b FROM walk w JOIN lv ON lv.scene=w.scene
      JOIN fx_pixel p ON p.scene=w.scene AND abs(p.i-w.i)<=1 AND abs(p.j-w.j)<=1
      WHERE p.no2>=lv.low AND NOT list_contains(w.seen, p.i*1000000+p.j) GROUP BY w.scene, w.way, w.seen) n),
    whole AS (SELECT * FROM walk WHERE scene IN (SELECT scene FROM walk WHERE way=1)),
    steps AS (SELECT scene, lat, lon, i*64+CASE WHEN i%2=0 THEN j ELSE 63-j END AS step_id, 4e0+j%3 AS wso FROM fx_pixel),
    met AS (SELECT a.scene, a.way, a.i, a.j, p.step_id, p.wso,
      row_number() OVER (PARTITION BY a.scene, a.way ORDER BY {hav('(35e0+a.i*0.05e0)','(-95e0+a.j*0.05e0)','p.lat','p.lon')}, p.step_id) AS rn
      FROM whole a JOIN steps p ON p.scene=a.scene)
    SELECT scene, CAST(way AS BIGINT) AS way, i, j, step_id, wso FROM met WHERE rn=1""",
    "fx_pixel",
)
def j07(t: Inputs) -> DataFrame:
    walk = sp.greedy_walk(t.pixel, scene_seeds(t), KEY)
    met = nearest_path_row(
        walk.withColumnRenamed("step_id", "way"), scene_clock(t).withColumnRenamed("tstmp", "met_time"), KEY, ["way"], ["met_time", "wso"]
    )
    return met.select("scene", F.col("way"), "i", "j", "step_id", "wso")
