"""Session helpers: construction for local runs and durable lineage cuts."""

from __future__ import annotations

import ctypes
import os
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

PLACE = ("__file", "__row")


def local_session(cores: str = "8", app: str = "plumeflux") -> SparkSession:
    """A session for tests and benchmarks; clusters bring their own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", cores)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", os.environ.get("BENCH_DRIVER_MEM", "12g"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def ship_package(spark: SparkSession) -> None:
    """Give the executors a zip of this package, once per application: they need no copy of the repository."""
    sc = spark.sparkContext
    if getattr(sc, "_plumeflux_shipped", False):
        return
    here = Path(__file__).resolve().parent
    target = os.path.join(tempfile.mkdtemp(prefix="plumeflux-zip-"), "plumeflux.zip")
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as out:
        for file in sorted(here.rglob("*.py")):
            out.write(file, file.relative_to(here.parent).as_posix())
    sc.addPyFile(target)
    sc._plumeflux_shipped = True


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the checkpoint folder the cluster names; make one only for local runs."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is not None:
        return
    named = sc.getConf().get("spark.checkpoint.dir", None)
    if named:
        sc.setCheckpointDir(named)
    elif sc.master.startswith("local"):
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="plumeflux-ckpt-"))
    else:
        raise RuntimeError("set spark.checkpoint.dir to a shared folder before running iterative operators")


def cut_lineage(df: DataFrame) -> DataFrame:
    """Materialise ``df`` as a compressed table in the shared checkpoint folder and read it back.

    The files survive executor loss, and later steps read only the columns they need.
    """
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    path = f"{spark.sparkContext.getCheckpointDir()}/tables/{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def release_memory() -> None:
    """Give back to the system what the allocators of Arrow and C hold of memory already freed.

    A Python worker lives on from stage to stage, so what one stage has freed would lie beside the needs of
    the next, in every worker of an executor.
    """
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
    if trim:
        trim(0)


def released(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run`` of mapInArrow that releases memory when its task ends."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            release_memory()

    return task


def released_group(run: Callable[[pa.Table], pa.Table]) -> Callable[[pa.Table], pa.Table]:
    """``run`` of applyInArrow that releases memory after each group."""

    def group(table: pa.Table) -> pa.Table:
        out = run(table)
        release_memory()
        return out

    return group


def with_places(docs: DataFrame, *columns: str | Column) -> DataFrame:
    """``columns`` of ``docs`` (all by default) and the place of every row (file path and row index, columns of PLACE),
    which tells equal rows apart.

    ``docs`` is a table that was read, else it is written first. Its own columns may have any names; those taken
    along must differ from PLACE.
    """

    def placed(table: DataFrame) -> DataFrame:
        at = table.metadataColumn("_metadata")
        return table.select(*(columns or ("*",)), at["file_path"].alias(PLACE[0]), at["row_index"].alias(PLACE[1]))

    try:
        return placed(docs)
    except AnalysisException:
        return placed(cut_lineage(docs))
