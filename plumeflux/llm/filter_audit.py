"""How document filters interact: an audit by incremental retraction streaming (operator 12)."""

from __future__ import annotations

import itertools
import json
import uuid
from collections.abc import Callable, Iterator, Mapping

import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from plumeflux.llm.exact_dedup import state_session, stream_files
from plumeflux.session import ensure_checkpoint_dir

DUPLICATE = "E"
WINDOW_ROWS = 100_000  # rows that a task combines at a time
BUCKET_TEXTS = 128  # texts that share a state entry, about


def words(text: Column) -> Column:
    return F.array_remove(F.split(text, r"[ \x09-\x0D]+"), "")


def short(text: Column) -> Column:
    return F.size(words(text)) < 50


def repetitive(text: Column) -> Column:
    return 100 * F.size(F.array_distinct(words(text))) < 65 * F.size(words(text))


def shouting(text: Column) -> Column:
    return 100 * F.length(F.regexp_replace(text, "[^A-Z]+", "")).cast("bigint") > 5 * F.length(text).cast("bigint")


def marked(text: Column) -> Column:
    return text.rlike(r"[#$%&*|]")


#: Conditions on the text (never null) under which a filter removes a document; the duplicate filter comes on top.
FILTERS: dict[str, Callable[[Column], Column]] = {"A": short, "B": repetitive, "C": shouting, "D": marked}


def failures(docs: DataFrame, labels: DataFrame, filters: Mapping[str, Callable[[Column], Column]], key: str, text: str, part: str) -> DataFrame:
    """Per row: digest, id, part and ``flags``: bit k for the k-th filter, then (past the duplicate filter's bit) good and toxic."""
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    mask = sum((F.when(fails(body), 1 << k).otherwise(0) for k, fails in enumerate(filters.values())), F.lit(0))
    rows = docs.select(F.unhex(F.sha2(body.cast("binary"), 256)).alias("digest"), F.col(key).alias("id"), F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"), mask.alias("mask"))
    # rows without an id have no label; a number of their own keeps them from meeting in one task
    rows = rows.withColumn("lone", F.when(F.col("id").isNull(), F.xxhash64("digest", "part")).otherwise(F.lit(0).cast("bigint")))
    known = labels.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("id")).agg(F.max(F.col("quality") == 1).alias("good"), F.max(F.col("toxic") == 1).alias("toxic"))
    joined = rows.join(known.withColumn("lone", F.lit(0).cast("bigint")), ["id", "lone"], "left")
    yes = lambda c, bit: F.when(F.col(c), 1 << bit).otherwise(0)
    return joined.select("digest", "id", "part", (F.col("mask") + yes("good", len(filters) + 1) + yes("toxic", len(filters) + 2)).alias("flags"))


def combine(window_rows: int, duplicate: int, bits: int):
    """Equal texts of a task meet before the shuffle.

    Every row is counted here: as a duplicate if an equal text with a smaller id is in the same window, as
    none otherwise. Counts go on under a (negative) key of the task; of each text only the rows of its smallest
    id go on to its state, which corrects the counts where another task or batch has a smaller id. State
    keys are the first ``bits`` bits of the text's digest.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mark = -1 - TaskContext.get().partitionId()
        texts: dict[bytes, tuple[object, int, dict[str, int]]] = {}
        counts: dict[tuple[str, int], int] = {}
        schema = None

        def count(part: str, flags: int, n: int) -> None:
            counts[part, flags] = counts.get((part, flags), 0) + n

        def flush() -> pa.RecordBatch:
            rows = [(int.from_bytes(d[:8], "big") >> (64 - bits), d, i, p, f, n) for d, (i, f, parts) in texts.items() for p, n in parts.items()]
            rows += [(mark, None, None, p, f, n) for (p, f), n in counts.items()]
            texts.clear()
            counts.clear()
            columns = list(zip(*rows)) if rows else [[]] * 6
            kinds = (pa.int64(), pa.binary(), schema[1].type, pa.string(), pa.int32(), pa.int64())
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names=["bucket", "digest", "id", "part", "flags", "n"])

        seen = 0
        for batch in batches:
            schema = batch.schema
            for digest, key, part, flags in zip(*(c.to_pylist() for c in batch.columns)):
                if key is None:
                    count(part, flags, 1)
                    continue
                held = texts.get(digest)
                if held is None or key < held[0]:
                    if held:
                        for p, n in held[2].items():
                            count(p, held[1], -n)
                            count(p, held[1] | duplicate, n)
                    texts[digest] = (key, flags, {part: 1})
                    count(part, flags, 1)
                elif key == held[0]:
                    held[2][part] = held[2].get(part, 0) + 1
                    count(part, flags, 1)
                else:
                    count(part, flags | duplicate, 1)
            seen += batch.num_rows
            if seen >= window_rows:
                yield flush()
                seen = 0
        if schema is not None:
            yield flush()

    return run


def retract(duplicate: int):
    """Keyed text state: per text the smallest id so far, its flags and its rows per part.

    A smaller id retracts the rows of the earlier one from the counts and puts them back as duplicates; a
    larger id's own rows are retracted so. Nothing goes out for a text that is met for the first time. A
    state entry holds the texts of one bucket, as parallel lists: a call of Python per text costs too much.
    """

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if key[0] < 0:  # counts of a task
            for pdf in frames:
                yield pdf[["part", "flags", "n"]]
            return
        held: dict[bytes, tuple[object, int, dict[str, int]]] = {}
        for digest, i, f, part, n in zip(*state.get) if state.exists else ():
            held.setdefault(bytes(digest), (i, f, {}))[2][part] = n
        out: list[tuple[str, int, int]] = []
        for pdf in frames:
            for digest, i, part, f, n in zip(*(pdf[c].tolist() for c in ("digest", "id", "part", "flags", "n"))):
                digest = bytes(digest)
                smallest, flags, parts = held.get(digest, (None, 0, {}))
                if smallest is None or i < smallest:
                    for q, m in parts.items():
                        out += [(q, flags, -m), (q, flags | duplicate, m)]
                    held[digest] = (i, f, {part: n})
                elif i == smallest:
                    parts[part] = parts.get(part, 0) + n
                else:
                    out += [(part, f, -n), (part, f | duplicate, n)]
        entries = [(d, i, f, q, m) for d, (i, f, parts) in held.items() for q, m in parts.items()]
        state.update(tuple(list(c) for c in zip(*entries)))
        if out:
            yield pd.DataFrame(out, columns=["part", "flags", "n"])

    return run


def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per part and flags of a task's corrections and counts."""
    sums: dict[tuple[str, int], int] = {}
    for batch in batches:
        for part, flags, n in zip(*(c.to_pylist() for c in batch.columns)):
            sums[part, flags] = sums.get((part, flags), 0) + n
    rows = [(p, f, n) for (p, f), n in sums.items() if n]
    columns = list(zip(*rows)) if rows else [[]] * 3
    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int32(), pa.int64()))], names=["part", "flags", "n"])


def count_files(
    spark: SparkSession, path: str, labels: DataFrame, filters: Mapping[str, Callable[[Column], Column]] = FILTERS, key: str = "doc_id", text: str = "text", part: str = "source",
    folder: str | None = None, max_files: int = 10_000, window_rows: int = WINDOW_ROWS,
) -> DataFrame:
    """Feed the files at ``path`` into the audit's state; rows per part and set of failed filters, as part, flags, n.

    ``folder`` holds checkpoint, state and the log of counter changes. A later call with the same
    folder takes up new files only, and retracts what they change; an interrupted one goes on where
    it ended, since state and log are committed per micro-batch. ``labels`` are read anew each time.
    """
    ensure_checkpoint_dir(spark)
    folder = folder or f"{spark.sparkContext.getCheckpointDir()}/state/{uuid.uuid4().hex}"
    own = state_session(spark)
    duplicate = 1 << len(filters)
    stream = stream_files(own, path, max_files)
    rows = failures(stream, labels, filters, key, text, part)
    kind = rows.schema["id"].dataType.simpleString()
    combined = rows.mapInArrow(combine(window_rows, duplicate, bucket_bits(spark, path, folder)), f"bucket bigint, digest binary, id {kind}, part string, flags int, n bigint")
    state = f"digests array<binary>, ids array<{kind}>, flags array<int>, parts array<string>, rows array<bigint>"
    changes = combined.groupBy("bucket").applyInPandasWithState(retract(duplicate), "part string, flags int, n bigint", state, "append", GroupStateTimeout.NoTimeout)
    log = changes.mapInArrow(add_up, "part string, flags int, n bigint")
    sink = log.writeStream.format("parquet").outputMode("append").option("checkpointLocation", f"{folder}/checkpoint").option("path", f"{folder}/log")
    sink.trigger(availableNow=True).start().awaitTermination()
    held = spark.read.schema(log.schema).option("ignoreMissingFiles", "true").parquet(f"{folder}/log")
    return held.groupBy("part", "flags").agg(F.sum("n").alias("n")).where("n <> 0")


def bucket_bits(spark: SparkSession, path: str, folder: str) -> int:
    """Bits of a digest that name its bucket: from the rows of the first call's files, then as the folder has it.

    Should the table outgrow its first size many times, entries grow with it; a new folder deals anew.
    """
    try:
        held = spark.read.schema("bits int").parquet(f"{folder}/buckets").first()
    except AnalysisException:  # no such table yet
        held = None
    if held:
        return held["bits"]
    bits = (spark.read.parquet(path).count() // BUCKET_TEXTS).bit_length()
    spark.createDataFrame([(bits,)], "bits int").coalesce(1).write.mode("overwrite").parquet(f"{folder}/buckets")
    return bits


def audit_table(counts: DataFrame, letters: str) -> DataFrame:
    """Per part, order of the filters and step: kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley.

    ``counts`` (part, flags, n) has at most 2 ** (filters + 2) rows a part; they meet every order and step.
    """
    bit = {c: 1 << k for k, c in enumerate(letters)}
    steps = [{"filter_order": "".join(o), "step": k + 1, "bit": bit[c], "earlier": sum(bit[x] for x in o[:k])} for o in itertools.permutations(letters) for k, c in enumerate(o)]
    every = F.from_json(F.lit(json.dumps(steps)), "array<struct<filter_order:string,step:int,bit:int,earlier:int>>")
    mask = F.col("flags") % (1 << len(letters))
    good, toxic = (F.when(F.col("flags").bitwiseAND(1 << (len(letters) + k)) != 0, F.col("n")).otherwise(0) for k in (0, 1))
    masks = counts.groupBy("part", mask.alias("mask")).agg(F.sum("n").alias("n"), F.sum(good).alias("good"), F.sum(toxic).alias("toxic"))
    met = masks.withColumn("at", F.explode(every)).select("part", "mask", "n", "good", "toxic", "at.*")
    fails, gone = F.col("mask").bitwiseAND(F.col("bit")) != 0, F.col("mask").bitwiseAND(F.col("earlier")) != 0

    def total(c: str, on: Column) -> Column:
        return F.sum(F.when(on, F.col(c)).otherwise(0))

    per_step = met.groupBy("part", "filter_order", "step", "bit").agg(
        total("n", ~fails & ~gone).alias("kept"),
        total("n", fails & ~gone).alias("removed"),
        total("n", fails & gone).alias("redundant"),
        total("n", F.col("mask") == F.col("bit")).alias("unique_fails"),
        total("good", fails & ~gone).alias("good_lost"),
        total("toxic", fails & ~gone).alias("toxic_lost"),
    )
    shapley = F.sum("removed").over(Window.partitionBy("part", "bit"))
    return per_step.withColumn("shapley", shapley).drop("bit")


def audit_files(spark: SparkSession, path: str, labels: DataFrame, filters: Mapping[str, Callable[[Column], Column]] = FILTERS, **options) -> DataFrame:
    """The audit of the files at ``path``: one row per part, order of the filters and step.

    A filter is a condition on the text; the last one, ``E``, fails a row whose text a row with a smaller key
    has, anywhere in the table. Texts are told apart by SHA-256. Null texts are empty, null parts the empty
    string; rows with a null key are nobody's duplicate and make none, rows that share key and text are no
    duplicates of each other. Of repeated labels of a key one is enough; keys without label are neither
    good nor toxic. An empty table gives no rows. Other columns are not read, whatever their names.
    """
    return audit_table(count_files(spark, path, labels, filters, **options), "".join(filters) + DUPLICATE)


def audit(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """``audit_files`` of a DataFrame, which is written to the shared folder first: a stream needs files."""
    ensure_checkpoint_dir(docs.sparkSession)
    path = f"{docs.sparkSession.sparkContext.getCheckpointDir()}/tables/{uuid.uuid4().hex}"
    wanted = [options.get("key", "doc_id"), options.get("text", "text"), options.get("part", "source")]
    docs.select(*wanted).write.option("compression", "zstd").parquet(path)
    return audit_files(docs.sparkSession, path, labels, **options)
