"""Composite jobs and the registered queries."""

from plumeflux.plans import (  # noqa: F401
    aggregate_queries,
    file_queries,
    filter_queries,
    fit_queries,
    job_queries,
    join_queries,
    raster_queries,
    series_queries,
)
from plumeflux.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
