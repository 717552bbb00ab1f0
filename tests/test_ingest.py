"""Ingest of granules that come in several files or batches, and of granules that cannot be used."""

from pathlib import Path

import pytest
from pyspark.sql import functions as F

from plumeflux.streaming import incremental
from plumeflux.streaming.incremental import incremental_ingest, read_ledger, run_batch

SCHEMA = "granule_id string, v double"


def count_rows(pending):
    return pending.groupBy("granule_id").agg(F.count(F.lit(1)).alias("n_pts")).withColumns({"overlap": F.lit(True), "status": F.lit("ok")})


def test_split_granules_lose_no_rows(spark, tmp_path):
    source, ledger, state = (str(tmp_path / n) for n in ("in", "ledger", "state"))

    def put(rows):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(source)

    def ingest():
        incremental_ingest(spark, source, SCHEMA, ledger, state, count_rows, valid=F.col("v") > 0).awaitTermination()
        return read_ledger(spark, ledger)

    put([("a", 1.0)] * 5)
    put([("a", 2.0)] * 3 + [("b", 1.0)])
    first = ingest()
    assert {r.granule_id: r.n for r in first.groupBy("granule_id").agg(F.sum("n_pts").alias("n")).collect()} == {"a": 8, "b": 1}
    put([("a", 3.0)] * 2 + [("c", 1.0), ("c", -1.0)])
    second = ingest()
    assert {r.granule_id: r.n for r in second.groupBy("granule_id").agg(F.sum("n_pts").alias("n")).collect()} == {"a": 10, "b": 1, "c": 0}
    assert [r.status for r in second.where("granule_id = 'c'").collect()] == ["clip_error"]
    # nothing new: nothing added, also when the stream's own checkpoint is lost
    assert ingest().count() == second.count()
    incremental_ingest(spark, source, SCHEMA, ledger, str(tmp_path / "other"), count_rows, valid=F.col("v") > 0).awaitTermination()
    assert read_ledger(spark, ledger).count() == second.count()


def per_facility(pending):
    """Two ledger rows per granule, so half a commit can list one facility of a granule only."""
    both = pending.withColumn("facility_id", F.explode(F.array(F.lit("x"), F.lit("y"))))
    rows = both.groupBy("granule_id", "facility_id").agg(F.count(F.lit(1)).alias("n_pts"))
    return rows.withColumns({"overlap": F.lit(True), "status": F.lit("ok")}).repartition(8, "granule_id", "facility_id")


def listed(spark, ledger):
    return sorted((r.granule_id, r.facility_id, r.n_pts) for r in read_ledger(spark, ledger).collect())


@pytest.mark.parametrize("again", ["first", "second"])
def test_half_a_commit_neither_loses_nor_doubles_rows(spark, tmp_path, monkeypatch, again):
    ledger = str(tmp_path / "ledger")
    items = spark.createDataFrame([(f"g{i}", 1.0) for i in range(6)], SCHEMA)
    whole = sorted((f"g{i}", f, 1) for i in range(6) for f in "xy")
    write = incremental.write_parquet

    def broken_off(rows, path, **options):
        if path.endswith(incremental.COMMITS):
            files = sorted(Path(ledger, incremental.ROWS).rglob("*.parquet"))
            assert len(files) > 1
            for file in files[::2]:
                file.unlink()
            raise OSError("lost while files were being moved")
        write(rows, path, **options)

    monkeypatch.setattr(incremental, "write_parquet", broken_off)
    with pytest.raises(OSError, match="lost"):
        run_batch(items, ledger, per_facility, batch="first")
    monkeypatch.undo()
    assert listed(spark, ledger) == []
    # the same batch again, or another one that brings the same items
    run_batch(items, ledger, per_facility, batch=again)
    assert listed(spark, ledger) == whole
    # a finished batch is not processed again, nor are its items in another one
    run_batch(items, ledger, per_facility, batch=again)
    run_batch(items, ledger, per_facility)
    assert listed(spark, ledger) == whole


def test_stream_repeats_a_batch_that_broke_off(spark, tmp_path, monkeypatch):
    source, ledger, state = (str(tmp_path / n) for n in ("in", "ledger", "state"))
    spark.createDataFrame([("a", 1.0), ("b", 1.0)], SCHEMA).repartition(2, "granule_id").write.parquet(source)
    commit = incremental.commit_rows

    def broken_off(rows, path, batch):
        commit(rows, path, batch)
        raise OSError("lost after the commit")

    monkeypatch.setattr(incremental, "commit_rows", broken_off)
    with pytest.raises(Exception, match="lost after the commit"):
        incremental_ingest(spark, source, SCHEMA, ledger, state, per_facility).awaitTermination()
    monkeypatch.undo()
    spark.createDataFrame([("c", 1.0)], SCHEMA).write.mode("append").parquet(source)
    incremental_ingest(spark, source, SCHEMA, ledger, state, per_facility).awaitTermination()
    assert listed(spark, ledger) == sorted((g, f, 1) for g in "abc" for f in "xy")
    # another stream over other files starts at batch 0 again and replaces nothing
    other = str(tmp_path / "other")
    spark.createDataFrame([("d", 1.0)], SCHEMA).write.parquet(other)
    incremental_ingest(spark, other, SCHEMA, ledger, str(tmp_path / "state2"), per_facility).awaitTermination()
    assert listed(spark, ledger) == sorted((g, f, 1) for g in "abcd" for f in "xy")
