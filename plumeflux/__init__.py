"""Point-source emission analytics on Spark: DataFrames in, DataFrames out."""

from plumeflux.config import FluxConfig

__all__ = ["FluxConfig"]
