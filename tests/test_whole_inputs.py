"""Registered jobs read whole inputs with the default settings."""

import os

import pytest
from pyspark.sql import functions as F

from plumeflux.config import FluxConfig
from plumeflux.fixtures import Inputs
from plumeflux.operators import raster as rs
from plumeflux.operators.trajectory import with_kinematics
from plumeflux.plans import job_queries, jobs, raster_queries

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def t(spark):
    return Inputs(spark, SF)


def test_flux_pipeline_reads_all_days(t, monkeypatch):
    seen = []
    monkeypatch.setattr(jobs, "flux_pipeline", lambda inp, cfg: seen.append((inp, cfg)))
    job_queries.pipeline(t)
    inp, cfg = seen[0]
    assert cfg.quality == FluxConfig().quality
    days = {r[0] for r in t.grid.select("valid_time").distinct().collect()}
    for fields, first in ((inp.fields, 30), (inp.oh_fields, 0)):
        hours = fields.groupBy(F.date_trunc("day", "valid_time").alias("d")).agg(F.count_distinct("valid_time").alias("n"), F.min(F.minute("valid_time")).alias("m"))
        assert {(r.d, r.n, r.m) for r in hours.collect()} == {(d, 24, first) for d in days}
    clock = with_kinematics(inp.trajectory, list(inp.keys)).select(F.date_trunc("day", "time_tag").alias("d"))
    used = {r.d for r in clock.distinct().collect()}
    assert len(days) > 1 and used - {None} <= {min(days) + (max(days) - min(days)) * k / max(1, (max(days) - min(days)).days) for k in range((max(days) - min(days)).days + 1)} and len(used) > 1


def test_spine_goes_through_the_mask(t):
    mask = {tuple(r) for r in raster_queries.scene_mask(t).select("scene", "i", "j").collect()}
    spine = {tuple(r) for r in raster_queries.scene_spine(t).select("scene", "i", "j").collect()}
    assert spine and spine <= mask
    dim = {tuple(r) for r in rs.mask_pixels(raster_queries.scene_mask(t), t.pixel, ["scene"]).where("no2 <= 45").select("scene", "i", "j").collect()}
    assert dim  # the fixed limit would leave these out


def test_scene_clock_has_every_pixel(t):
    clock = raster_queries.scene_clock(t)
    assert clock.count() == t.pixel.count() == clock.select("scene", "step_id").distinct().count()


def test_transects_have_every_point(spark):
    from plumeflux.plans import QUERIES

    per = QUERIES["h04_transect_points_all"](spark, SF).groupBy("facility_id", "step_id").agg(F.count_distinct("k").alias("n"), F.count(F.lit(1)).alias("rows"))
    assert {(r.n, r.rows) for r in per.select("n", "rows").distinct().collect()} == {(401, 401)}
