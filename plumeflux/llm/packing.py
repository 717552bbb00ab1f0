"""Packing documents into token windows (operator 8)."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumeflux.llm.pieces import spread, token_chunks
from plumeflux.session import cut_lineage, released, released_group

WINDOW = 4096
PIECES_PER_TASK = 50_000


class OpenWindows:
    """Open windows by remaining capacity: a segment tree over capacities, each with a stack of windows."""

    def __init__(self, window: int):
        self.size = 1 << window.bit_length()
        self.tree = bytearray(2 * self.size)  # 1 where some window below has room left
        self.stacks: dict[int, list[int]] = {}

    def add(self, capacity: int, window: int) -> None:
        if capacity <= 0:
            return
        self.stacks.setdefault(capacity, []).append(window)
        k = capacity + self.size
        while k and not self.tree[k]:
            self.tree[k] = 1
            k >>= 1

    def take(self, need: int) -> tuple[int, int] | None:
        """The open window with the least capacity of at least ``need``."""
        k = need + self.size
        if not self.tree[k]:
            while k > 1 and ((k & 1) or not self.tree[k + 1]):
                k >>= 1
            if k <= 1:
                return None
            k += 1
            while k < self.size:
                k = 2 * k if self.tree[2 * k] else 2 * k + 1
        capacity = k - self.size
        stack = self.stacks[capacity]
        window = stack.pop()
        if not stack:
            while k and not (k < self.size and (self.tree[2 * k] or self.tree[2 * k + 1])):
                self.tree[k] = 0
                k >>= 1
        return capacity, window


def best_fit_decreasing(lengths: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Window number and offset of every piece; pieces come in decreasing length."""
    where, offset = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    windows, made = OpenWindows(window), 0
    for k, need in enumerate(lengths.tolist()):
        found = windows.take(need)
        capacity, number = found if found else (window, made)
        made += found is None
        where[k], offset[k] = number, window - capacity
        windows.add(capacity - need, number)
    return where, offset


def document_pieces(
    docs: DataFrame, path: str, end_id: int, key: str = "doc_id", text: str = "text", window: int = WINDOW, with_ids: bool = False
) -> DataFrame:
    """Pieces of the documents' ids: full windows from the start, then what is left.

    Per piece: key, start, length, ids_crc32, doc_tokens and, if asked, the ids themselves. Every
    document ends with ``end_id``; a null or empty text is that one id. One scan, no shuffle.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.column(0)
            carry: tuple[int, list[np.ndarray]] | None = None
            rows, starts, lengths, crcs, totals, lists = [], [], [], [], [], []

            def close(row: int, parts: list[np.ndarray]) -> None:
                ids = np.concatenate([*parts, np.array([end_id], np.uint32)]).astype("<u4")
                for at in range(0, len(ids), window):
                    piece = ids[at : at + window]
                    rows.append(row)
                    starts.append(at)
                    lengths.append(len(piece))
                    crcs.append(zlib.crc32(piece))
                    totals.append(len(ids))
                    if with_ids:
                        lists.append(piece.astype(np.int64))

            done = 0  # rows closed so far; chunks come in row order and may end within a row
            for of, inverse, at, table, _ in token_chunks(batch.column(1), path, spaces=False):
                if len(of) == 0:
                    continue
                n = np.diff(at)[inverse]
                ids = table[spread(at[:-1][inverse], n)]
                ends = np.cumsum(n)
                edges = np.flatnonzero(of[1:] != of[:-1]) + 1
                for a, b in zip([0, *edges.tolist()], [*edges.tolist(), len(of)]):
                    row = int(of[a])
                    part = ids[ends[a] - n[a] : ends[b - 1]]
                    if carry and carry[0] == row:
                        carry[1].append(part)
                        continue
                    if carry:
                        close(*carry)
                        done = carry[0] + 1
                    for empty in range(done, row):
                        close(empty, [])
                    done, carry = row, (row, [part])
            if carry:
                close(*carry)
                done = carry[0] + 1
            for empty in range(done, batch.num_rows):
                close(empty, [])
            columns = [keys.take(pa.array(rows, pa.int64())), *(pa.array(x, pa.int64()) for x in (starts, lengths, crcs, totals))]
            names = [key, "start", "length", "ids_crc32", "doc_tokens"]
            if with_ids:
                columns.append(pa.array(lists, pa.list_(pa.int64())))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(columns, names=names)

    kind = docs.schema[key].dataType.simpleString()
    schema = f"`{key}` {kind}, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint"
    return docs.select(F.col(key), F.col(text)).mapInArrow(released(cut), schema + (", ids array<bigint>" if with_ids else ""))


def pack(pieces: DataFrame, window: int = WINDOW, per_task: int = PIECES_PER_TASK) -> DataFrame:
    """Add sequence_id and offset to pieces (columns ``length`` of 1 to ``window`` and any others).

    Pieces are dealt by hash into groups of about ``per_task``, each packed in one task by best fit
    decreasing; a group leaves a window or two open, a padding share that falls with ``per_task``.
    The number of groups follows the number of pieces; a document's pieces are dealt one by one, so no
    key makes a large group. ``sequence_id`` is the group times 2**32 plus the window in it.
    """
    total = pieces.count()
    groups = max(1, -(-total // per_task))
    deal = F.pmod(F.xxhash64(*[c for c in pieces.columns if c != "ids"]), F.lit(groups))
    copies = F.pmod(F.monotonically_increasing_id(), F.lit(groups)) if groups > 1 else F.lit(0)

    def place(dealt: pa.Table) -> pa.Table:
        # columns stay in Arrow: as numbers of pandas, long keys beside a null would change
        group = dealt["__group"][0].as_py()
        order = [c for c in dealt.column_names if c not in ("__group", "length", "ids", "__copy")]
        dealt = dealt.take(pc.sort_indices(dealt, [("length", "descending"), *[(c, "ascending") for c in order]]))
        where, offset = best_fit_decreasing(dealt["length"].to_numpy(), window)
        placed = dealt.drop_columns(["__group", "__copy"]).append_column("sequence_id", pa.array((group << 32) + where, pa.int64()))
        return placed.append_column("offset", pa.array(offset, pa.int64()))

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema.fields)
    # repeated rows share their hash: a share of the row number keeps a third of all rows from one group
    spread_out = pieces.withColumn("__copy", copies.cast("bigint")).withColumn("__group", F.pmod(deal + F.col("__copy"), F.lit(groups)))
    return spread_out.groupBy("__group").applyInArrow(released_group(place), f"{fields}, sequence_id bigint, offset bigint")


def pack_documents(docs: DataFrame, path: str, end_id: int = 2, key: str = "doc_id", text: str = "text", window: int = WINDOW) -> DataFrame:
    """All documents in sequences of at most ``window`` tokens, one row per piece.

    Columns: key, start, length, ids_crc32, doc_tokens, sequence_id, offset. Null keys and repeated rows
    are packed like any other row; an empty table gives no rows; other columns are not read. The slim
    piece table is written to the shared folder once, since it is counted before it is dealt.
    """
    return pack(cut_lineage(document_pieces(docs, path, end_id, key, text, window)), window)


def sequences(docs: DataFrame, path: str, end_id: int = 2, pad_id: int = 0, key: str = "doc_id", text: str = "text", window: int = WINDOW) -> DataFrame:
    """Training rows: sequence_id, input_ids (padded to ``window``, but not at a power of two) and piece lengths."""
    placed = pack(cut_lineage(document_pieces(docs, path, end_id, key, text, window, with_ids=True)), window)
    parts = F.array_sort(F.collect_list(F.struct("offset", "length", "ids")))  # at most ``window`` pieces in a sequence
    rows = placed.groupBy("sequence_id").agg(parts.alias("parts"), F.sum("length").alias("n"))
    ids = F.flatten(F.col("parts.ids"))
    power = F.bit_count(F.col("n")) == 1
    padded = F.concat(ids, F.array_repeat(F.lit(pad_id).cast("bigint"), F.when(power, 0).otherwise(window - F.col("n")).cast("int")))
    return rows.select("sequence_id", padded.alias("input_ids"), F.col("parts.length").alias("lengths"))
