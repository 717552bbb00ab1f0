"""Writers; every dataset is partitioned by what its readers prune on."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumeflux.operators.filters import keep_columns


def to_float32(df: DataFrame) -> DataFrame:
    """Doubles become floats at rest; other types stay."""
    return df.select(*[F.col(n).cast("float").alias(n) if t == "double" else F.col(n) for n, t in df.dtypes])


def write_parquet(df: DataFrame, path: str, partition_by: Sequence[str] = (), mode: str = "append") -> None:
    """Append rows; each partition value is written by few tasks, hot ones by several."""
    out = df
    if partition_by:
        # rebalance spreads a hot partition value over several files of the advisory size
        out = df.hint("rebalance", *partition_by)
    writer = out.write.mode(mode).option("compression", "zstd")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


def write_overpass_index(overpass: DataFrame, path: str) -> None:
    write_parquet(overpass, path)


def write_clipped(clipped: DataFrame, path: str, keep: Sequence[str], keys: Sequence[str] = ("facility_id", "granule_id", "i", "j")) -> None:
    """Selected variables as float32, compressed, one folder per facility."""
    write_parquet(to_float32(keep_columns(clipped, keep, always=keys)), path, ["facility_id"])


def write_flux_rows(rows: DataFrame, path: str) -> None:
    write_parquet(rows, path, ["facility_id"])


def write_matched(rows: DataFrame, path: str) -> None:
    write_parquet(rows, path, mode="overwrite")
