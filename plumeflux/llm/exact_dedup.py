"""Exact dedup with streaming state (operator 1)."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from plumeflux.llm.bloom import FILTER_BYTES, likely_hit
from plumeflux.llm.url_filter import lower_ascii
from plumeflux.session import cut_lineage, ensure_checkpoint_dir

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def normalised(text: Column) -> Column:
    """A-Z lower-cased, null as empty."""
    return lower_ascii(F.coalesce(text, F.lit("")))


def sha256(text: Column) -> Column:
    """Lowercase hex digest of the UTF-8 bytes."""
    return F.sha2(text.cast("binary"), 256)


def stream_files(spark: SparkSession, path: str, max_files: int = 10_000, columns: Sequence[str] | None = None) -> DataFrame:
    """The Parquet files of a folder (or one file) as a stream of bounded micro-batches, with ``columns`` only if named."""
    schema = spark.read.parquet(path).schema
    if columns is not None:
        schema = StructType([schema[c] for c in columns])
    pattern = f"{path.rstrip('/')[:-1]}[{path.rstrip('/')[-1]}]"  # a pattern, since a stream takes no single file by name
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files).parquet(pattern)


def run_state(stream: DataFrame, digest: Callable[[Column], Column] = sha256, key: str = "doc_id", text: str = "text", checkpoint: str | None = None) -> tuple[str, DataFrame]:
    """Feed what the stream has now into the keyed state; give the checkpoint folder and the state as a table.

    State per digest: the stable identifier that stays (largest key), the content locator of its row
    (file and row in it), and the number of rows. It lies in RocksDB on the executors' disks, is kept
    without expiry, and every commit goes to the checkpoint in the shared folder, so a lost executor's
    part is loaded elsewhere and a later run with the same ``checkpoint`` goes on where this one ended.
    A hot digest is combined before the shuffle, then holds one state row.
    """
    spark = stream.sparkSession
    ensure_checkpoint_dir(spark)
    checkpoint = checkpoint or f"{spark.sparkContext.getCheckpointDir()}/state/{uuid.uuid4().hex}"
    rows = stream.select(
        digest(normalised(F.col(text))).alias("digest"),
        F.struct(F.col(key).alias("id"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row")).alias("at"),
    )
    state = rows.groupBy("digest").agg(F.max("at").alias("at"), F.count(F.lit(1)).alias("n"))
    query = state.writeStream.outputMode("update").format("noop").option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    held = spark.read.format("statestore").load(checkpoint).select(F.col("key.digest").alias("digest"), F.col("value.*"))
    at, n = [c for c in held.columns if c != "digest"]
    return checkpoint, held.select("digest", F.col(f"`{at}`").alias("at"), F.col(f"`{n}`").alias("n"))


def state_session(spark: SparkSession) -> SparkSession:
    """A session of the same application whose streams keep their state in RocksDB with bounded memory."""
    own = spark.newSession()
    for name in ("spark.sql.shuffle.partitions", "spark.sql.session.timeZone", "spark.sql.files.maxPartitionBytes"):
        own.conf.set(name, spark.conf.get(name))
    own.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    own.conf.set("spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage", "true")
    own.conf.set("spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB", "200")
    own.conf.set("spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled", "true")
    own.conf.set("spark.sql.streaming.stateStore.rocksdb.allowFAllocate", "false")  # many small states would each reserve disk
    return own


def dedup(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` without rows whose text an equal row with a larger key has; same columns.

    A stream needs files, so the rows are written to the shared folder first, and read back by the result.
    """
    spark = docs.sparkSession
    ensure_checkpoint_dir(spark)
    path = f"{spark.sparkContext.getCheckpointDir()}/tables/{uuid.uuid4().hex}"
    docs.write.option("compression", "zstd").parquet(path)
    return dedup_files(spark, path, key=key, text=text, keep_only=True)


def dedup_files(spark: SparkSession, path: str, digest: Callable[[Column], Column] = sha256, key: str = "doc_id", text: str = "text", max_files: int = 10_000, keep_only: bool = False, filter_bytes: int = FILTER_BYTES) -> DataFrame:
    """Every row of the files at ``path`` with keep_id, group_size, kept, text_sha256 (and all columns but the text).

    With ``keep_only`` the rows that stay, with all their columns, text too.

    Texts are equal when identical after lower-casing A-Z, null counting as empty; of equal texts the
    row with the largest key stays (null keys are smallest; of rows that share that key, one by its
    place in the files). Digests only retrieve: rows whose digest the state holds for another row too
    (hits) are compared byte by byte with the located content, and texts that only share a digest
    are grouped by their bytes. So the result is exact for any ``digest``.

    Rows meet the state by digest; only hits move their text. Hot digests are left to the skew splitting
    of adaptive joins. Empty tables give no rows. Other columns travel as one struct, so their names clash
    with nothing; those named like a column of the result are replaced by it.
    """
    own = state_session(spark)
    _, state = run_state(stream_files(own, path, max_files, [key, text]), digest, key, text)
    held = state.where("n > 1").select(F.col("digest").alias("__d"), F.col("at.id").alias("__kept_id"), F.col("at.file").alias("__kept_file"), F.col("at.row").alias("__kept_row"), "n")
    held = cut_lineage(held)

    docs = own.read.parquet(path)
    at = docs.metadataColumn("_metadata")
    place = (at["file_path"].alias("__file"), at["row_index"].alias("__row"))
    norm = normalised(F.col(text))
    added = ("keep_id", "group_size", "kept", "text_sha256")
    others = [c for c in docs.columns if c == key or c.lower() not in (text.lower(), *added)]
    rest = F.struct(*[F.col(f"`{c}`") for c in others]).alias("__rest")
    rows = docs.select(F.col(key).alias("__id"), rest, *place, norm.alias("__norm"), digest(norm).alias("__digest"))
    rows = rows.withColumn("text_sha256", F.col("__digest") if digest is sha256 else sha256(F.col("__norm")))
    # texts of possible hits only leave the scan; the filter is exact enough to spare nearly all others
    likely = likely_hit(held, held.count(), F.xxhash64("__digest"), filter_bytes)
    rows = cut_lineage(rows.withColumn("__norm", F.when(likely, F.col("__norm"))))
    single = rows.drop("__norm").join(held.select("__d"), F.col("__digest") == F.col("__d"), "left_anti")
    alone = single.select("__rest", F.col("__id").alias("keep_id"), F.lit(1).cast("bigint").alias("group_size"), F.lit(True).alias("kept"), "text_sha256")
    hits = rows.where(F.col("__norm").isNotNull()).join(held, F.col("__digest") == F.col("__d"))
    is_kept = (F.col("__file") == F.col("__kept_file")) & (F.col("__row") == F.col("__kept_row"))
    # the located content, once for each digest with hits
    content = hits.where(is_kept).select(F.col("__d").alias("__c"), F.col("__norm").alias("__kept_text"))
    compared = hits.join(content, F.col("__d") == F.col("__c"))
    same = F.col("__norm") == F.col("__kept_text")
    checked = cut_lineage(compared.select("__id", "__rest", "__file", "__row", "__digest", "__kept_id", "__kept_file", "__kept_row", "n", "text_sha256", same.alias("__same"), F.when(~same, F.col("__norm")).alias("__other")))
    # all rows of most digests agree with the located content; else groups are counted by their bytes
    clash = checked.where(~F.col("__same")).select("__digest").distinct()
    agree = checked.join(clash, "__digest", "left_anti")
    agreed = agree.select("__rest", F.col("__kept_id").alias("keep_id"), F.col("n").alias("group_size"), is_kept.alias("kept"), "text_sha256")
    mixed = checked.join(clash, "__digest", "left_semi")
    best = mixed.groupBy("__digest", "__other").agg(F.max(F.struct(F.col("__id").alias("id"), F.col("__file").alias("file"), F.col("__row").alias("row"))).alias("__best"), F.count(F.lit(1)).alias("__n"))
    best = best.select(F.col("__digest").alias("__d2"), F.col("__other").alias("__o2"), "__best", "__n")
    resolved_rows = mixed.join(best, (F.col("__digest") == F.col("__d2")) & F.col("__other").eqNullSafe(F.col("__o2")))
    kept = (F.col("__file") == F.col("__best.file")) & (F.col("__row") == F.col("__best.row"))
    resolved = resolved_rows.select("__rest", F.col("__best.id").alias("keep_id"), F.col("__n").alias("group_size"), kept.alias("kept"), "text_sha256")
    decided = alone.unionByName(agreed).unionByName(resolved)
    if not keep_only:
        return decided.select("__rest.*", *added)
    # one more scan, without the places of rows that go
    gone = agree.where(~is_kept).select("__file", "__row").unionByName(resolved_rows.where(~kept).select("__file", "__row"))
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__doc")
    return docs.select(whole, *place).join(gone, ["__file", "__row"], "left_anti").select("__doc.*")
