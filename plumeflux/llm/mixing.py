"""Mixing sources to target weights by pivotal dependent rounding (operator 6)."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plumeflux.llm.text import word_counts
from plumeflux.session import cut_lineage, released, released_group

ROWS_PER_TASK = 50_000
FAN_IN = 64


def with_sizes(docs: DataFrame, columns: Sequence[str], text: str = "text", size: str = "size") -> DataFrame:
    """``columns`` of every row and ``size``, the words of its text (null: 0). One scan, no shuffle."""
    columns = [c for c in columns if c != size]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = pa.array(word_counts(batch.column(len(columns))), pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], sizes], names=[*columns, size])

    fields = "".join(f"`{c}` {docs.schema[c].dataType.simpleString()}, " for c in columns)
    return docs.select(*columns, F.col(text).alias("__text")).mapInArrow(released(count), fields + f"`{size}` bigint")


def source_targets(sizes: DataFrame, weights: Sequence[int] = (3, 1, 2), share: float = 1.5, cap: float = 2.0, source: str = "source") -> DataFrame:
    """Per source: source_size, n_rows and target.

    Sources stand in code point order, null last, and take the weights in turn. ``share`` times all sizes
    is dealt by weight; a target stops at ``cap`` times its source's size and the excess goes to the
    others by weight until none is above. That fixed point fills sources in order of cap / weight, so
    running sums give it. The windows run over one row per source, not over documents.
    """
    per = sizes.groupBy(source).agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n_rows"))
    everything = Window.partitionBy(F.lit(1))
    turn = F.pmod(F.row_number().over(everything.orderBy(F.col(source).asc_nulls_last())) - 1, F.lit(len(weights)))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (turn + 1).cast("int"))
    rows = per.withColumn("__w", weight).withColumn("__cap", F.lit(float(cap)) * F.col("source_size"))
    rows = rows.withColumn("__at", F.col("__cap") / F.col("__w"))
    before = everything.orderBy("__at", F.col(source).asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    filled = F.coalesce(F.sum("__cap").over(before), F.lit(0.0))
    left = F.sum("__w").over(everything) - F.coalesce(F.sum("__w").over(before), F.lit(0.0))
    total = F.lit(float(share)) * F.sum("source_size").over(everything)
    rows = rows.withColumn("__level", (total - filled) / left)
    # the level holds from the first source that stays below its cap
    level = F.min(F.when(F.col("__level") < F.col("__at"), F.struct("__at", "__level"))).over(everything)["__level"]
    target = F.least(F.col("__cap"), F.coalesce(F.col("__w") * level, F.col("__cap")))
    return rows.select(source, "source_size", "n_rows", target.alias("target"))


def pivot(sizes: np.ndarray, p: np.ndarray, u: np.ndarray) -> np.ndarray:
    """Round probabilities to 0 or 1, keeping sum(size * p); at most one entry stays between.

    Rows are taken in the given order: the open row meets the next one and mass moves between them, one
    way or the other by ``u`` of the newcomer so that every expectation holds, until one is integral.
    """
    out = p.copy()
    a, q, draw = sizes.tolist(), p.tolist(), u.tolist()
    held = -1
    for j in range(len(a)):
        if not 0.0 < q[j] < 1.0:
            continue
        if held < 0:
            held = j
            continue
        i = held
        up = min(a[i] * (1.0 - q[i]), a[j] * q[j])  # mass that may move from j to i
        down = min(a[i] * q[i], a[j] * (1.0 - q[j]))  # and from i to j
        if draw[j] * (up + down) < down:
            if a[i] * (1.0 - q[i]) <= a[j] * q[j]:
                q[j], q[i] = q[j] - up / a[j], 1.0
                held = j
            else:
                q[i], q[j] = q[i] + up / a[i], 0.0
        else:
            if a[i] * q[i] <= a[j] * (1.0 - q[j]):
                q[j], q[i] = q[j] + down / a[j], 0.0
                held = j
            else:
                q[i], q[j] = q[i] - down / a[i], 1.0
        # rounding may land on a whole number, or beside it by the last digits
        q[held] = min(max(q[held], 0.0), 1.0)
        if not 1e-12 < q[held] < 1.0 - 1e-12:
            q[held] = float(round(q[held]))
            held = -1
    out[:] = q
    return out


def mix_sources(
    docs: DataFrame,
    weights: Sequence[int] = (3, 1, 2),
    share: float = 1.5,
    cap: float = 2.0,
    key: str = "doc_id",
    source: str = "source",
    text: str = "text",
    seed: int = 17,
    rows_per_task: int = ROWS_PER_TASK,
    keep: Sequence[str] = (),
) -> DataFrame:
    """How often the mix takes each document: key, source, size, source_size, target, copies, taken.

    All documents of a source get target / source_size expected copies: the whole part for sure, the rest
    by pivotal rounding that keeps the source's sum of words. Sources are cut into groups of about
    ``rows_per_task`` rows by hash, largest texts first in each; a group leaves at most one open row, and
    open rows meet in a tree of ``FAN_IN`` groups a level until one is left for each source, which goes to
    the nearer whole number. So a source misses its target by at most half of one document.

    Draws hash the key, size and seed: reruns agree whatever the partitioning. Columns to ``keep`` come
    along unread (a row's place, say); draws then hash the text too, so rows with null or repeated keys
    have draws of their own. Texts without words take 0. Null sources are a source of their own; null keys and repeated rows take part like other rows.
    """
    marked = docs.withColumn("__mark", F.xxhash64(text)) if keep else docs
    own = [key, "size", *(["__mark"] if keep else [])]
    sizes = cut_lineage(with_sizes(marked, [key, source, *keep, *own[2:]], text))
    targets = cut_lineage(source_targets(sizes, weights, share, cap, source))
    most = targets.agg(F.max("n_rows")).first()[0]
    if not most:
        none = sizes.limit(0)
        return none.select(key, source, "size", *keep, *[F.lit(0).cast(t).alias(c) for c, t in (("source_size", "bigint"), ("target", "double"), ("copies", "bigint"), ("taken", "bigint"))])
    buckets = F.ceil(F.col("n_rows") / F.lit(rows_per_task))
    draw = F.pmod(F.xxhash64(*own, F.lit(seed)), F.lit(1 << 40)) / F.lit(float(1 << 40))
    copies = F.col("target") / F.col("source_size")
    rows = sizes.join(targets.withColumnRenamed(source, "__s"), F.col(source).eqNullSafe(F.col("__s"))).drop("__s")
    rows = rows.withColumn("__c", F.when(F.col("source_size") > 0, copies).otherwise(0.0))
    rows = rows.select(
        key, source, "size", *keep, "source_size", "target",
        F.floor("__c").alias("__whole"),
        F.when(F.col("size") > 0, F.col("__c") - F.floor("__c")).otherwise(0.0).alias("__p"),
        draw.alias("__u"),
        F.pmod(F.xxhash64(*own, F.lit(seed + 1)), buckets).alias("__bucket"),
    )
    schema = rows.schema

    def settle(last: bool):
        def run(group: pa.Table) -> pa.Table:
            # keys stay in Arrow: as numbers of pandas, long ones beside a null would change
            group = group.take(pc.sort_indices(group, [("size", "descending"), (key, "ascending"), ("__u", "ascending")]))
            p = pivot(*(group[c].to_numpy() for c in ("size", "__p", "__u")))
            if last:
                left = (p > 0.0) & (p < 1.0)
                p[left] = np.round(p[left])
            return group.set_column(group.column_names.index("__p"), "__p", pa.array(p))

        return run

    levels, width = 1, -(-most // rows_per_task)
    while width > 1:
        levels, width = levels + 1, -(-width // FAN_IN)
    done, open_rows = [], rows
    for level in range(levels):
        placed = open_rows.groupBy(source, "__bucket").applyInArrow(released_group(settle(level == levels - 1)), schema)
        if level < levels - 1:
            placed = cut_lineage(placed)
            between = (F.col("__p") > 0) & (F.col("__p") < 1)
            open_rows = placed.where(between).withColumn("__bucket", F.floor(F.col("__bucket") / F.lit(FAN_IN)).cast("bigint"))
            placed = placed.where(~between)
        done.append(placed)
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    times = F.col("__whole") + F.col("__p").cast("bigint")
    return out.select(key, source, "size", *keep, "source_size", "target", times.alias("copies"), (times * F.col("size")).alias("taken"))
