"""Packing documents into as few sequences as possible by minimum bin slack (operator 11)."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plumeflux.llm.pieces import spread, token_chunks
from plumeflux.session import cut_lineage

WINDOW = 2048


def row_ids(column: pa.Array, path: str, end_id: int) -> Iterator[tuple[int, np.ndarray]]:
    """Every row's number and its token ids with ``end_id`` behind them; a null or empty text is that one id."""
    end = np.array([end_id], "<u4")
    row, parts = 0, []
    for of, inverse, at, table, _ in token_chunks(column, path, spaces=True):
        n = np.diff(at)[inverse]
        ids = table[spread(at[:-1][inverse], n)].astype("<u4")
        stop = np.cumsum(n)
        edges = np.flatnonzero(of[1:] != of[:-1]) + 1
        for a, b in zip([0, *edges.tolist()], [*edges.tolist(), len(of)]):
            if a == b:
                continue
            while row < of[a]:
                yield row, np.concatenate([*parts, end])
                row, parts = row + 1, []
            parts.append(ids[stop[a] - n[a] : stop[b - 1]])
    while row < len(column):
        yield row, np.concatenate([*parts, end])
        row, parts = row + 1, []


def length_ranks(lengths: np.ndarray, seen: np.ndarray) -> np.ndarray:
    """For each piece the number of pieces of its length before it; ``seen`` counts on."""
    order = np.argsort(lengths, kind="stable")
    ordered = lengths[order]
    first = np.searchsorted(ordered, ordered, "left")
    rank = np.empty(len(lengths), np.int64)
    rank[order] = np.arange(len(lengths)) - first + seen[ordered]
    seen += np.bincount(lengths, minlength=len(seen))
    return rank


def document_pieces(docs: DataFrame, path: str, end_id: int = 0, key: str = "doc_id", text: str = "text", window: int = WINDOW, with_ids: bool = False) -> DataFrame:
    """Pieces of the documents' ids: a document of more than ``window`` ids is cut into full windows, its first piece taking what is over.

    Per piece: key, piece, start, length, ids_crc32, the task that cut it (``part``) and how many
    pieces of its length that task cut before (``rank``); if asked, the ids. One scan, no shuffle.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        seen = np.zeros(window + 1, np.int64)
        for batch in batches:
            rows, pieces, starts, lengths, crcs, lists = [], [], [], [], [], []
            for row, ids in row_ids(batch.column(1), path, end_id):
                over = len(ids) % window
                bounds = [0, *range(over or window, len(ids) + 1, window)]
                for k, (a, b) in enumerate(zip(bounds, bounds[1:])):
                    rows.append(row)
                    pieces.append(k)
                    starts.append(a)
                    lengths.append(b - a)
                    crcs.append(zlib.crc32(ids[a:b]))
                    if with_ids:
                        lists.append(ids[a:b].astype(np.int64))
            sizes = np.array(lengths, np.int64)
            columns = [batch.column(0).take(pa.array(rows, pa.int64())), pa.array(pieces, pa.int32()), pa.array(starts, pa.int64()), pa.array(sizes)]
            columns += [pa.array(crcs, pa.int64()), pa.array(np.full(len(rows), part, np.int32)), pa.array(length_ranks(sizes, seen))]
            names = [key, "piece", "start", "length", "ids_crc32", "part", "rank"]
            if with_ids:
                columns.append(pa.array(lists, pa.list_(pa.int64())))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(columns, names=names)

    kind = docs.schema[key].dataType.simpleString()
    schema = f"`{key}` {kind}, piece int, start bigint, length bigint, ids_crc32 bigint, part int, rank bigint"
    return docs.select(F.col(key), F.col(text)).mapInArrow(cut, schema + (", ids array<bigint>" if with_ids else ""))


def fullest(counts: dict[int, int], room: int) -> dict[int, int]:
    """Copies per length whose sum is the largest that ``room`` takes, from ``counts`` available copies.

    Subset sums as bits of an integer: bit s is set where some choice among the lengths so far sums to
    s. Lengths come in rising order; going back from the longest, as many copies of a length are taken as
    the shorter ones can complete to the same sum. So of equally full choices the one with the longest
    pieces is found, and short pieces last until they are needed.
    """
    mask, reach = (1 << (room + 1)) - 1, 1
    steps: list[tuple[int, int, int]] = []  # length, copies it may take, sums of the shorter ones
    for length in sorted(x for x in counts if x <= room):
        left = copies = min(counts[length], room // length)
        steps.append((length, copies, reach))
        some = 1
        while left and reach != mask:  # 1, 2, 4, ... copies at a time make every number of copies up to all
            some = min(some, left)
            reach |= (reach << (length * some)) & mask
            left -= some
            some *= 2
    at, chosen = reach.bit_length() - 1, {}
    for length, copies, shorter in reversed(steps):
        if length <= at:
            take = next(m for m in range(min(copies, at // length), -1, -1) if shorter >> (at - m * length) & 1)
            if take:
                chosen[length] = take
                at -= take * length
    return chosen


def bin_patterns(counts: dict[int, int], window: int) -> list[tuple[int, dict[int, int]]]:
    """Bins of minimum slack over ``counts`` pieces per length: (number of equal bins, copies per length).

    Each bin takes the longest piece left and the fullest combination for its remaining room, which is
    then removed. The same combination stays the fullest while its pieces last, so it is removed as
    often as they do. A pattern leaves some length too few pieces for another such bin, which halves
    that length's pieces at least, so there are at most about 4 * ``window`` patterns, however many pieces.
    """
    left = {x: n for x, n in counts.items() if n > 0}
    patterns = []
    while left:
        longest = max(left)
        rest = dict(left)
        rest[longest] -= 1
        chosen = fullest({x: n for x, n in rest.items() if n}, window - longest)
        chosen[longest] = chosen.get(longest, 0) + 1
        times = min(left[x] // m for x, m in chosen.items())
        patterns.append((times, chosen))
        for x, m in chosen.items():
            left[x] -= times * m
            if not left[x]:
                del left[x]
    return patterns


def slot_table(patterns: list[tuple[int, dict[int, int]]]) -> dict[str, np.ndarray]:
    """Where the pieces of a length go by their rank: runs of ranks with their first sequence, pieces per sequence and offset."""
    rows, used, sequence = [], {}, 0
    for times, chosen in patterns:
        offset = 0
        for length, m in sorted(chosen.items(), reverse=True):
            first = used.get(length, 0)
            rows.append((length, first, sequence, m, offset))
            used[length] = first + times * m
            offset += length * m
        sequence += times
    rows.sort()
    table = np.array(rows, np.int64).reshape(-1, 5)
    return dict(zip(("length", "first", "sequence", "per", "offset"), table.T))


def place(slots: dict[str, np.ndarray], length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sequence and offset of pieces by length and rank among all pieces of that length."""
    run = np.searchsorted((slots["length"] << 44) | slots["first"], (length << 44) | rank, "right") - 1
    nth = rank - slots["first"][run]
    return slots["sequence"][run] + nth // slots["per"][run], slots["offset"][run] + nth % slots["per"][run] * length


def pack(pieces: DataFrame, window: int = WINDOW) -> DataFrame:
    """Add sequence_id and offset to a written table of ``document_pieces``.

    Only the number of pieces per length (at most ``window`` numbers, summed on the executors) decides
    what the bins look like, so all pieces are packed together, not by groups: the driver makes a few
    thousand patterns of bins from it, whatever the number of pieces. A piece finds its bin by its rank
    among the pieces of its length (below 2**44): the rank within the task that cut it, plus the counts of
    the tasks before. So a length that a third of all pieces have is spread over the tasks like any other.
    """
    of_task = pieces.groupBy("length", "part").agg(F.count(F.lit(1)).alias("__n"))
    histogram = {r["length"]: r["n"] for r in of_task.groupBy("length").agg(F.sum("__n").alias("n")).collect()}
    slots = slot_table(bin_patterns(histogram, window))
    earlier = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    before = of_task.select("length", "part", F.coalesce(F.sum("__n").over(earlier), F.lit(0)).alias("__before"))
    ranked = pieces.join(before, ["length", "part"]).withColumn("rank", F.col("rank") + F.col("__before"))

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sequence, offset = place(slots, batch.column("length").to_numpy(), batch.column("rank").to_numpy())
            kept = [n for n in batch.schema.names if n != "rank"]
            yield pa.RecordBatch.from_arrays([*[batch.column(n) for n in kept], pa.array(sequence), pa.array(offset)], names=[*kept, "sequence_id", "offset"])

    kept = [f for f in pieces.schema.fields if f.name not in ("part", "rank")]
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept)
    return ranked.select(*[f"`{f.name}`" for f in kept], "rank").mapInArrow(put, f"{fields}, sequence_id bigint, offset bigint")


def pack_documents(docs: DataFrame, path: str, end_id: int = 0, key: str = "doc_id", text: str = "text", window: int = WINDOW) -> DataFrame:
    """All documents in as few sequences of at most ``window`` tokens as minimum bin slack finds, one row per piece.

    Columns: key, piece (from 0), start, length, ids_crc32, sequence_id, offset. ``path`` names a
    byte-level vocabulary of the tokenizers library. Null and empty texts are one id; null keys and repeated
    rows are packed like any other row; a very long text makes many full pieces; equal lengths are told
    apart by their place in the input; an empty table gives no rows; other columns are not read, whatever
    their names. The slim piece table is written to the shared folder once, since it is counted first.
    """
    return pack(cut_lineage(document_pieces(docs, path, end_id, key, text, window)), window)


def sequences(docs: DataFrame, path: str, end_id: int = 0, key: str = "doc_id", text: str = "text", window: int = WINDOW) -> DataFrame:
    """Training rows without padding: sequence_id, input_ids and the lengths of the pieces in it."""
    placed = pack(cut_lineage(document_pieces(docs, path, end_id, key, text, window, with_ids=True)), window)
    parts = F.array_sort(F.collect_list(F.struct("offset", "length", "ids")))  # at most ``window`` pieces in a sequence
    rows = placed.groupBy("sequence_id").agg(parts.alias("parts"))
    return rows.select("sequence_id", F.flatten(F.col("parts.ids")).alias("input_ids"), F.col("parts.length").alias("lengths"))
