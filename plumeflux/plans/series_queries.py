"""Registered queries for ordered-series operators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumeflux.fixtures import Inputs
from plumeflux.functions import timeconv as T
from plumeflux.operators import trajectory as tr
from plumeflux.plans.registry import query

KEY = ["facility_id"]


def hav(a: str, b: str, c: str, d: str) -> str:
    return (
        f"2*6371000e0*asin(sqrt(power(sin(radians({c}-{a})/2),2)"
        f"+cos(radians({a}))*cos(radians({c}))*power(sin(radians({d}-{b})/2),2)))"
    )


def bear(a: str, b: str, c: str, d: str) -> str:
    y = f"sin(radians({d})-radians({b}))*cos(radians({c}))"
    x = (
        f"cos(radians({a}))*sin(radians({c}))-sin(radians({a}))*cos(radians({c}))*cos(radians({d})-radians({b}))"
    )
    return f"fmod(degrees(atan2({y},{x}))+360e0,360e0)"


def wrap(d: str) -> str:
    return f"(fmod(fmod({d}+180e0,360e0)+360e0,360e0)-180e0)"


W = "(PARTITION BY facility_id ORDER BY step_id)"
NEAR = f"""near AS (SELECT *, lag(lat) OVER {W} AS plat, lag(lon) OVER {W} AS plon, lead(lat) OVER {W} AS nlat,
 lead(lon) OVER {W} AS nlon, first_value(lat) OVER {W} AS lat0, first_value(lon) OVER {W} AS lon0,
 first_value(tstmp) OVER {W} AS t0 FROM fx_trajectory)"""


@query(
    "e01_step_distance",
    f"WITH {NEAR} SELECT facility_id, step_id, round(coalesce({hav('plat','plon','lat','lon')},0e0),4) AS step_m FROM near",
    "fx_trajectory",
)
def e01(t: Inputs) -> DataFrame:
    return tr.step_distance(t.trajectory, KEY).select("facility_id", "step_id", F.round("step_m", 4).alias("step_m"))


@query(
    "e02_cumulative_distance",
    f"""WITH {NEAR} SELECT facility_id, step_id,
    round(sum(coalesce({hav('plat','plon','lat','lon')},0e0)) OVER {W}/1000e0, 6) AS age_km FROM near""",
    "fx_trajectory",
)
def e02(t: Inputs) -> DataFrame:
    return tr.cumulative_distance(t.trajectory, KEY).select("facility_id", "step_id", F.round("age_km", 6).alias("age_km"))


@query(
    "e03_bearing_from_first",
    f"""WITH {NEAR} SELECT facility_id, step_id, round(CASE WHEN step_id=0 THEN {bear('lat','lon','nlat','nlon')}
    ELSE {bear('lat0','lon0','lat','lon')} END, 4) AS wd FROM near""",
    "fx_trajectory",
)
def e03(t: Inputs) -> DataFrame:
    return tr.with_kinematics(t.trajectory, KEY, None).select("facility_id", "step_id", F.round("wd", 4).alias("wd"))


DT = """dt AS (SELECT facility_id, CAST(floor((max(CASE WHEN step_id=2 THEN epoch_us(tstmp) END)
 - max(CASE WHEN step_id=1 THEN epoch_us(tstmp) END))/1e6) AS DOUBLE) AS dt FROM fx_trajectory GROUP BY 1)"""


@query(
    "e04_forward_wind",
    f"""WITH {NEAR}, {DT} SELECT n.facility_id, step_id,
    round({hav('lat','lon','nlat','nlon')}/dt, 8) AS wso, round({hav('lat','lon','lat','nlon')}/dt, 8) AS u,
    round({hav('lat','nlon','nlat','nlon')}/dt, 8) AS v FROM near n JOIN dt USING (facility_id)""",
    "fx_trajectory",
)
def e04(t: Inputs) -> DataFrame:
    wind = tr.with_kinematics(t.trajectory, KEY, None, zero_dt="ieee")
    return wind.select("facility_id", "step_id", *[F.round(c, 8).alias(c) for c in ("wso", "u", "v")])


@query(
    "e04_forward_wind_repeat_last",
    f"""WITH {NEAR}, {DT}, w AS (SELECT n.facility_id, step_id, {hav('lat','lon','nlat','nlon')}/dt AS wso
    FROM near n JOIN dt USING (facility_id))
    SELECT facility_id, step_id, round(coalesce(wso, lag(wso) OVER {W}), 8) AS wso FROM w""",
    "fx_trajectory",
)
def e04b(t: Inputs) -> DataFrame:
    wind = tr.with_kinematics(t.trajectory, KEY, None, last_row="repeat", zero_dt="ieee")
    return wind.select("facility_id", "step_id", F.round("wso", 8).alias("wso"))


@query(
    "e05_time_tag",
    f"""WITH {NEAR} SELECT facility_id, step_id,
    epoch_us(TIMESTAMP '2024-02-01 12:00:00') - (epoch_us(tstmp) - epoch_us(t0)) AS time_tag_us FROM near""",
    "fx_trajectory",
)
def e05(t: Inputs) -> DataFrame:
    tagged = tr.with_kinematics(t.trajectory.withColumn("t_overpass", F.expr("TIMESTAMP '2024-02-01 12:00:00'")), KEY)
    return tagged.select("facility_id", "step_id", T.micros("time_tag").alias("time_tag_us"))


@query(
    "e06_segments",
    f"""WITH {NEAR} SELECT facility_id, step_id, round((lat+nlat)/2, 6) AS lat_mid, round((lon+nlon)/2, 6) AS lon_mid,
    round({bear('lat','lon','nlat','nlon')},4) AS seg_bearing,
    round(fmod({bear('lat','lon','nlat','nlon')}+90e0,360e0),4) AS perp_bearing FROM near WHERE nlat IS NOT NULL""",
    "fx_trajectory",
)
def e06(t: Inputs) -> DataFrame:
    s = tr.segments(t.trajectory, KEY)
    return s.select(
        "facility_id",
        "step_id",
        *[F.round(c, 6).alias(c) for c in ("lat_mid", "lon_mid")],
        *[F.round(c, 4).alias(c) for c in ("seg_bearing", "perp_bearing")],
    )


A3 = """a AS (SELECT facility_id, step_id, lat AS lat_tdump, lon AS lon_tdump,
 lat + 0.01e0*((step_id*7)%11) AS lat_a3, lon - 0.01e0*((step_id*5)%13) AS lon_a3 FROM fx_trajectory),
 n AS (SELECT *, """ + ", ".join(
    f"first_value({c}) OVER {W} AS f_{c}, lead({c}) OVER {W} AS n_{c}" for c in ("lat_a3", "lon_a3", "lat_tdump", "lon_tdump")
) + " FROM a)"


def _diff_sql(p: str) -> str:
    fitted = bear("f_lat_a3", "f_lon_a3", f"{p}lat_a3", f"{p}lon_a3")
    path = bear("f_lat_tdump", "f_lon_tdump", f"{p}lat_tdump", f"{p}lon_tdump")
    return wrap(f"({fitted} - {path})")


@query(
    "e07_direction_difference",
    f"""WITH {A3} SELECT facility_id, step_id, round(CASE WHEN step_id=0 THEN {_diff_sql('n_')} ELSE {_diff_sql('')} END, 4)
    AS wd_diff FROM n""",
    "fx_trajectory",
)
def e07(t: Inputs) -> DataFrame:
    rows = t.trajectory.select(
        "facility_id",
        "step_id",
        F.col("lat").alias("lat_tdump"),
        F.col("lon").alias("lon_tdump"),
        (F.col("lat") + 0.01 * ((F.col("step_id") * 7) % 11)).alias("lat_a3"),
        (F.col("lon") - 0.01 * ((F.col("step_id") * 5) % 13)).alias("lon_a3"),
    )
    return tr.direction_difference(rows, KEY).select("facility_id", "step_id", F.round("wd_diff", 4).alias("wd_diff"))


@query(
    "e08_path_outliers",
    f"""WITH {NEAR}, a AS (SELECT facility_id, step_id, {wrap('(' + bear('lat','lon','nlat','nlon') + '-' + bear('plat','plon','lat','lon') + ')')} AS turn,
      {hav('plat','plon','lat','lon')} AS step FROM near),
    b AS (SELECT *, lead(turn) OVER {W} AS tnext, count(*) OVER (PARTITION BY facility_id) AS n FROM a),
    m AS (SELECT facility_id, median(step) AS med FROM a GROUP BY 1),
    d AS (SELECT a.facility_id, median(abs(step-med)) AS mad FROM a JOIN m USING (facility_id) GROUP BY 1)
    SELECT b.facility_id, step_id, NOT (n>=3 AND (coalesce(CASE WHEN tnext IS NOT NULL THEN
      abs(turn)>45 AND abs(tnext)>45 AND sign(turn)<>sign(tnext) ELSE abs(turn)>45 END,false)
      OR coalesce(step > med+3*mad,false))) AS inlier
    FROM b JOIN m USING (facility_id) JOIN d USING (facility_id)""",
    "fx_trajectory",
)
def e08(t: Inputs) -> DataFrame:
    flagged = tr.flag_path_outliers(t.trajectory, KEY)
    return flagged.select("facility_id", "step_id", "inlier")


@query(
    "e09_reindex",
    """SELECT facility_id, row_id, row_number() OVER (PARTITION BY facility_id ORDER BY age_hours, row_id)-1 AS idx
    FROM fx_flux""",
    "fx_flux",
)
def e09(t: Inputs) -> DataFrame:
    seg = F.floor(F.col("age_hours") * 100)
    return tr.reindex(t.flux, KEY, ["age_hours", "row_id"], seg).select("facility_id", "row_id", "idx")


@query(
    "e10_drop_repeats",
    """SELECT facility_id, age_hours, min(row_id) AS row_id, arg_min(flux, row_id) AS flux FROM fx_flux GROUP BY 1,2""",
    "fx_flux",
)
def e10(t: Inputs) -> DataFrame:
    rows = t.flux.select("facility_id", "age_hours", "row_id", "flux")
    return tr.drop_repeats(rows, KEY, "age_hours", "row_id")


@query(
    "e11_piecewise_lookup",
    """WITH node AS (SELECT facility_id, age_hours AS x, min(flux) AS y FROM fx_flux GROUP BY 1,2),
    q AS (SELECT overpass_id, facility_id, ((overpass_id*13)%120)/100e0 AS ask FROM fx_overpass),
    lo AS (SELECT overpass_id, max(x) AS x, arg_max(y, x) AS y FROM q JOIN node USING (facility_id) WHERE x<=ask GROUP BY 1),
    hi AS (SELECT overpass_id, min(x) AS x, arg_min(y, x) AS y FROM q JOIN node USING (facility_id) WHERE x>=ask GROUP BY 1)
    SELECT q.overpass_id, q.ask, round(CASE WHEN lo.x IS NULL THEN hi.y WHEN hi.x IS NULL OR hi.x=lo.x THEN lo.y
      ELSE lo.y+(hi.y-lo.y)*(ask-lo.x)/(hi.x-lo.x) END, 6) AS value
    FROM q LEFT JOIN lo USING (overpass_id) LEFT JOIN hi USING (overpass_id)""",
    "fx_flux fx_overpass",
)
def e11(t: Inputs) -> DataFrame:
    asks = t.overpass.select("overpass_id", "facility_id", (((F.col("overpass_id") * 13) % 120) / 100.0).alias("ask"))
    found = tr.piecewise_lookup(asks, t.flux, KEY, "ask", "age_hours", "flux", "value", segment_width=0.05)
    return found.select("overpass_id", "ask", F.round("value", 6).alias("value"))


@query(
    "e12_pixel_corners",
    """WITH a AS (SELECT scene,i,j,lat,lon, lag(lat) OVER wi AS pa, lead(lat) OVER wi AS na, lag(lon) OVER wi AS po,
      lead(lon) OVER wi AS no FROM fx_pixel WINDOW wi AS (PARTITION BY scene,j ORDER BY i)),
    b AS (SELECT scene,i,j, coalesce((pa+lat)/2, lat-((lat+na)/2-lat)) AS al, coalesce((lat+na)/2, lat+(lat-(pa+lat)/2)) AS ah,
      coalesce((po+lon)/2, lon-((lon+no)/2-lon)) AS ol, coalesce((lon+no)/2, lon+(lon-(po+lon)/2)) AS oh FROM a),
    c AS (SELECT *, lag(al) OVER w AS pal, lead(al) OVER w AS nal, lag(ah) OVER w AS pah, lead(ah) OVER w AS nah,
      lag(ol) OVER w AS pol, lead(ol) OVER w AS nol, lag(oh) OVER w AS poh, lead(oh) OVER w AS noh
      FROM b WINDOW w AS (PARTITION BY scene,i ORDER BY j))
    SELECT scene,i,j, round(coalesce((pal+al)/2, al-((al+nal)/2-al)),6) AS lat_tl,
      round(coalesce((ol+nol)/2, ol+(ol-(pol+ol)/2)),6) AS lon_tr,
      round(coalesce((ah+nah)/2, ah+(ah-(pah+ah)/2)),6) AS lat_br,
      round(coalesce((poh+oh)/2, oh-((oh+noh)/2-oh)),6) AS lon_bl FROM c""",
    "fx_pixel",
)
def e12(t: Inputs) -> DataFrame:
    c = tr.derive_corners(t.pixel.select("scene", "i", "j", "lat", "lon"), ["scene"])
    return c.select(
        "scene",
        "i",
        "j",
        F.round(F.col("lat_bounds")[0], 6).alias("lat_tl"),
        F.round(F.col("lon_bounds")[1], 6).alias("lon_tr"),
        F.round(F.col("lat_bounds")[2], 6).alias("lat_br"),
        F.round(F.col("lon_bounds")[3], 6).alias("lon_bl"),
    )


@query(
    "e13_emission_time",
    """SELECT row_id, epoch_us(t_overpass) - CAST(round(age_hours*3600000000e0) AS BIGINT) AS t_emission_us FROM fx_flux""",
    "fx_flux",
)
def e13(t: Inputs) -> DataFrame:
    return t.flux.select("row_id", T.micros(T.minus_hours("t_overpass", "age_hours")).alias("t_emission_us"))


@query(
    "e14_mid_time",
    """SELECT overpass_id, epoch_us(t_start) + (epoch_us(t_end)-epoch_us(t_start))//2 AS t_mid_us FROM fx_overpass""",
    "fx_overpass",
)
def e14(t: Inputs) -> DataFrame:
    return t.overpass.select("overpass_id", T.micros(T.midpoint("t_start", "t_end")).alias("t_mid_us"))
