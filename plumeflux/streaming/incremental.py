"""Resumable ingest: the same batch function run once or on a file stream with a checkpoint."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from plumeflux.operators.aggregates import ingest_report
from plumeflux.sources.sinks import write_parquet

LEDGER_SCHEMA = (
    "granule_id string, parts array<string>, facility_id string, t_granule timestamp, overlap boolean, n_pts bigint, latmin double, latmax double, "
    "lonmin double, lonmax double, trop_file string, t_trop_mid timestamp, dt_min double, status string"
)
# A ledger is a folder: the rows of each batch in a folder of their own, and the names of finished batches.
ROWS, COMMITS = "rows", "commits"


def _read(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The table at ``path``; empty when none was written yet."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def finished_batches(spark: SparkSession, path: str) -> DataFrame:
    """One row (batch) per batch whose rows were all written."""
    return _read(spark, f"{path}/{COMMITS}", "batch string").distinct()


def read_ledger(spark: SparkSession, path: str, without: str | None = None) -> DataFrame:
    """The ledger so far, rows of finished batches only; empty when none was written yet.

    Rows of the batch ``without`` are not even read, so that its folder can be written anew meanwhile.
    """
    rows = _read(spark, f"{path}/{ROWS}", f"{LEDGER_SCHEMA}, batch string")
    if without is not None:
        rows = rows.where(F.col("batch") != without)
    return rows.join(finished_batches(spark, path), "batch", "left_semi").drop("batch")


def commit_rows(rows: DataFrame, path: str, batch: str) -> None:
    """Write a batch's rows, then its name.

    Rows count from the moment the name is there. A batch that broke off before leaves rows that nobody
    reads; written again under its name it replaces them, whatever the file system keeps of a job that was cut off.
    """
    write_parquet(rows, f"{path}/{ROWS}/batch={batch}", mode="overwrite")
    name = rows.sparkSession.range(1).select(F.lit(batch).alias("batch")).coalesce(1)
    write_parquet(name, f"{path}/{COMMITS}")


def not_yet_done(items: DataFrame, ledger: DataFrame, key: str = "granule_id") -> DataFrame:
    """Items without a ledger row (any outcome counts as done)."""
    return items.join(ledger.select(key).distinct(), key, "left_anti")


def failed_rows(failed: DataFrame, status: str) -> DataFrame:
    """Ledger rows for items that could not be read or clipped."""
    return failed.select("granule_id").withColumns({"overlap": F.lit(False), "n_pts": F.lit(0).cast("bigint"), "status": F.lit(status)})


def run_batch(
    items: DataFrame,
    ledger_path: str,
    process: Callable[[DataFrame], DataFrame],
    key: str = "granule_id",
    part: str | None = None,
    valid: Column | None = None,
    status: str = "clip_error",
    batch: str | None = None,
) -> DataFrame:
    """Process the items the ledger does not list, add their outcome, return the updated report.

    ``process`` maps pending items to ledger rows. They are committed by ``batch`` (letters, digits, dashes; a
    new name by default): a batch that is finished is not processed again, one that broke off
    is processed whole, and its earlier rows are replaced. A granule may come in several parts (files) and
    batches: with the column ``part`` the unit that is done is a granule's part, and each batch adds a
    row for the parts it brought; clip ranges of such a row are those of its parts. Granules with a row
    where ``valid`` does not hold are listed with ``status`` and the rest of the batch goes on.
    """
    spark = items.sparkSession
    batch = uuid.uuid4().hex if batch is None else batch
    if not finished_batches(spark, ledger_path).where(F.col("batch") == batch).isEmpty():
        return ingest_report(read_ledger(spark, ledger_path))
    ledger = read_ledger(spark, ledger_path, without=batch)
    if part is None:
        pending, parts = not_yet_done(items, ledger, key), None
    else:
        # rows written without parts stand for the whole granule
        pending = not_yet_done(items, ledger.where(F.col("parts").isNull()), key)
        done = ledger.select(key, F.explode("parts").alias(part))
        pending = pending.join(done, [key, part], "left_anti")
        parts = pending.groupBy(key).agg(F.collect_set(part).alias("parts"))
    shape = spark.createDataFrame([], LEDGER_SCHEMA)

    def outcome(rows: DataFrame) -> DataFrame:
        listed = rows.select(*[c for c in rows.columns if c in shape.columns and c != "parts"])
        if parts is not None:
            listed = listed.join(parts, key, "left")
        return shape.unionByName(listed, allowMissingColumns=True).select(*shape.columns)

    if valid is None:
        out = outcome(process(pending))
    else:
        broken = pending.where(~F.coalesce(valid, F.lit(False))).select(key).distinct()
        out = outcome(process(pending.join(broken, key, "left_anti"))).unionByName(outcome(failed_rows(broken, status)))
    commit_rows(out, ledger_path, batch)
    return ingest_report(read_ledger(spark, ledger_path))


def incremental_ingest(
    spark: SparkSession,
    source: str,
    schema: StructType | str,
    ledger_path: str,
    checkpoint: str,
    process: Callable[[DataFrame], DataFrame],
    valid: Column | None = None,
) -> StreamingQuery:
    """Consume new parquet files under ``source`` once and stop; safe to run again after a failure.

    A file lies in one batch whole, so a granule's part is its file. Batches are named by the query's id,
    which its checkpoint keeps, and their number; a stream with a new checkpoint has names of its own.
    """

    def batch(df: DataFrame, number: int) -> None:
        query = spark.sparkContext.getLocalProperty("sql.streaming.queryId")
        if query is None:
            raise RuntimeError("the stream's id is not known in this thread")
        run_batch(df, ledger_path, process, part="__file", valid=valid, batch=f"{query}-{number}")

    stream = spark.readStream.schema(schema).parquet(source).select("*", F.col("_metadata.file_path").alias("__file"))
    return (
        stream.writeStream.foreachBatch(batch)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
