"""Centroid clustering of integer vectors with a PCA-rotated filter (operator 13)."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumeflux.session import cut_lineage

WIDTH = 64
SCALE = 256
LEAD = 16  # rotated coordinates that are stored; how many changes the work, never the result
SMALL = 1 << 26  # integers below this keep all distances within 64 bits
LIMB = 32
LARGEST = (1 << 63) - 1


def kept_vectors(vectors: DataFrame, key: str = "vec_id", embedding: str = "embedding", width: int = WIDTH) -> DataFrame:
    """``key`` and ``vec`` (doubles) of the vectors with exactly ``width`` components, none null or non-finite."""
    x = F.col(embedding)
    bad = F.exists(x, lambda v: v.isNull() | F.isnan(v.cast("double")) | (F.abs(v.cast("double")) == F.lit(float("inf"))))
    return vectors.where(F.size(x) == width).where(~bad).select(F.col(key), x.cast("array<double>").alias("vec"))


def whole(x: float, scale: int) -> int:
    """floor(scale * x) of a finite double as a Python integer, of any size."""
    y = scale * x
    return math.floor(y) if math.isfinite(y) else scale * int(x)


def matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), width)


def moments(vectors: DataFrame, width: int, scale: int) -> tuple[np.ndarray, np.ndarray, float]:
    """Sum, sum of outer products and number of all vectors: sums of the tasks' sums, width * (width + 3) / 2 + 1 numbers.

    Components count within +-SMALL here, since the rotation decides only how tight the filter is.
    """
    upper = np.triu_indices(width)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, s, p = 0, np.zeros(width), np.zeros((width, width))
        for batch in batches:
            with np.errstate(over="ignore"):
                m = np.clip(np.floor(matrix(batch.column(0), width) * scale), -SMALL, SMALL)
            n, s, p = n + len(m), s + m.sum(0), p + m.T @ m
        values = np.concatenate([[n], s, p[upper]])
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(values), dtype=np.int32)), pa.array(values)], names=["at", "value"])

    sums = vectors.select("vec").mapInArrow(add, "at int, value double").groupBy("at").agg(F.sum("value").alias("value")).collect()
    flat = np.zeros(1 + width + len(upper[0]))
    for r in sums:
        flat[r["at"]] = r["value"]
    products = np.zeros((width, width))
    products[upper] = flat[1 + width :]
    return flat[1 : 1 + width], products + np.triu(products, 1).T, flat[0]


class Rotation:
    """Principal axes of the vectors around their mean; the first ``lead`` coordinates and the norm of the rest."""

    def __init__(self, sums: np.ndarray, products: np.ndarray, n: float, lead: int):
        self.mean = sums / max(n, 1.0)
        spread = products / max(n, 1.0) - np.outer(self.mean, self.mean)
        self.axes = np.linalg.eigh(spread)[1][:, ::-1]
        self.lead = min(lead, len(self.mean))

    def turn(self, m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        turned = (m - self.mean) @ self.axes
        return turned[:, : self.lead], np.sqrt((turned[:, self.lead :] ** 2).sum(1))


def rotated_table(vectors: DataFrame, rotation: Rotation, key: str, scale: int) -> DataFrame:
    """Per vector: key, ``ints`` (whole numbers), ``lead`` and ``rest`` (residual norm); ``vec`` instead where a number is too large for 64-bit distances."""
    width = len(rotation.mean)

    def turn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            m = matrix(batch.column(1), width)
            with np.errstate(over="ignore"):
                floors = np.floor(m * scale)
            small = (np.abs(floors) < SMALL).all(1)
            lead, rest = rotation.turn(np.where(small[:, None], floors, 0.0))
            lists = lambda x, kind, on: pa.array([v if k else None for v, k in zip(x, on.tolist())], pa.list_(kind))
            ints = lists(np.where(small[:, None], floors, 0.0).astype(np.int32), pa.int32(), small)
            yield pa.RecordBatch.from_arrays([batch.column(0), ints, lists(lead, pa.float64(), small), pa.array(rest), lists(m, pa.float64(), ~small)], names=[key, "ints", "lead", "rest", "vec"])

    kind = vectors.schema[key].dataType.simpleString()
    return vectors.select(key, "vec").mapInArrow(turn, f"`{key}` {kind}, ints array<int>, lead array<double>, rest double, vec array<double>")


class Nearest:
    """The nearest centroid of vectors by exact integer distances, ties to the smaller number."""

    def __init__(self, centroids: list[list[int]], rotation: Rotation):
        self.exact = centroids
        large = max(abs(v) for c in centroids for v in c) >= SMALL
        self.c = None if large else np.array(centroids, np.int64)
        if not large:
            self.lead, self.rest = rotation.turn(self.c.astype(float))
            self.norm = (self.lead**2).sum(1) + self.rest**2

    def by_filter(self, ints: np.ndarray, lead: np.ndarray, rest: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """Cluster and squared distance of each row, and how many exact distances it took.

        Projected distance plus the squared difference of residual norms bounds the distance from below.
        The centroid of the lowest bound is measured first; only those whose bound is not above that
        distance are measured too.
        """
        size = (lead**2).sum(1) + rest**2
        bound = (lead**2).sum(1)[:, None] - 2 * lead @ self.lead.T + (self.lead**2).sum(1) + (rest[:, None] - self.rest) ** 2
        bound -= 1e-9 * (size[:, None] + self.norm) + 1e-6  # never above the true distance, whatever was rounded
        first = bound.argmin(1)
        upper = ((ints - self.c[first]) ** 2).sum(1)
        rows, cents = np.nonzero(bound <= upper[:, None])
        distance = np.empty(len(rows), np.int64)
        for at in range(0, len(rows), 1 << 16):  # bounded memory where little is filtered
            some = slice(at, at + (1 << 16))
            distance[some] = ((ints[rows[some]] - self.c[cents[some]]) ** 2).sum(1)
        order = np.lexsort((cents, distance, rows))
        best = order[np.searchsorted(rows[order], np.arange(len(ints)))]
        return cents[best].astype(np.int32), distance[best], len(rows) + len(ints)

    def by_hand(self, v: list[int]) -> tuple[int, int]:
        distances = [sum((a - b) ** 2 for a, b in zip(v, c)) for c in self.exact]
        k = min(range(len(distances)), key=distances.__getitem__)
        return k, distances[k]


def assigned(batch: pa.RecordBatch, nearest: Nearest, scale: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, list | np.ndarray]]:
    """Row numbers, clusters, squared distances and integer vectors of a batch (columns key, ints, lead, rest, vec), a part at a time."""
    width = len(nearest.exact[0])
    small = batch.column(1).is_valid().to_numpy(zero_copy_only=False)
    at = np.flatnonzero(small)
    ints = matrix(batch.column(1).drop_null(), width).astype(np.int64)
    if nearest.c is None:
        at, by_hand = at[:0], [(row, v.tolist()) for row, v in zip(at, ints)]
    else:
        by_hand = []
    for lo in range(0, len(at), 4096):
        part = slice(lo, lo + 4096)
        lead = matrix(batch.column(2).drop_null().slice(lo, 4096), nearest.lead.shape[1])
        clusters, distances, _ = nearest.by_filter(ints[part], lead, batch.column(3).to_numpy()[at[part]])
        yield at[part], clusters, distances, ints[part]
    by_hand += [(row, [whole(x, scale) for x in batch.column(4)[int(row)].as_py()]) for row in np.flatnonzero(~small)]
    if by_hand:
        found = [nearest.by_hand(v) for _, v in by_hand]
        rows = np.array([row for row, _ in by_hand], np.int64)
        yield rows, np.array([k for k, _ in found], np.int32), np.array([min(d, LARGEST) for _, d in found], np.int64), [v for _, v in by_hand]


def cluster_sums(table: DataFrame, nearest: Nearest, scale: int) -> dict[int, tuple[int, list[int]]]:
    """Number and componentwise sum of every cluster's vectors, exact whatever their number and size.

    A task sends one sum per cluster and component, cut into limbs of 32 bits, so the whole is one
    shuffle of bounded rows per task and plain sums; the driver gets clusters * width of them.
    """
    width = len(nearest.exact[0])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[int, int] = {}
        sums: dict[int, list[int]] = {}
        for batch in batches:
            for _, clusters, _, vectors in assigned(batch, nearest, scale):
                for k in np.unique(clusters).tolist():
                    mine = np.flatnonzero(clusters == k)
                    # below 2**26 each, at most 4096 rows: far from 64 bits
                    part = vectors[mine].sum(0).tolist() if isinstance(vectors, np.ndarray) else [sum(x) for x in zip(*(vectors[r] for r in mine))]
                    counts[k] = counts.get(k, 0) + len(mine)
                    sums[k] = [a + b for a, b in zip(sums.get(k, [0] * width), part)]
        rows = [(k, -1, 0, n) for k, n in counts.items()]
        for k, components in sums.items():
            for at, v in enumerate(components):
                sign, v, limb = (-1 if v < 0 else 1), abs(v), 0
                while v:
                    rows.append((k, at, limb, sign * (v & ((1 << LIMB) - 1))))
                    v, limb = v >> LIMB, limb + 1
        columns = list(zip(*rows)) if rows else [[]] * 4
        kinds = (pa.int32(), pa.int32(), pa.int32(), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names=["cluster", "at", "limb", "value"])

    parts = table.mapInArrow(add, "cluster int, at int, limb int, value bigint")
    out: dict[int, tuple[int, list[int]]] = {}
    for r in parts.groupBy("cluster", "at", "limb").agg(F.sum("value").alias("value")).collect():
        n, components = out.get(r["cluster"], (0, [0] * width))
        if r["at"] < 0:
            n = r["value"]
        else:
            components[r["at"]] += r["value"] << (LIMB * r["limb"])
        out[r["cluster"]] = (n, components)
    return out


def first_centroids(vectors: DataFrame, k: int, seed: str, key: str, scale: int) -> list[list[int]]:
    """The ``k`` vectors with the smallest sha256 of ``seed:key`` (null keys last; ties: by components), in that order."""
    mark = F.sha2(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")).cast("binary"), 256)
    first = vectors.orderBy(mark.asc_nulls_last(), "vec").limit(k).select("vec").collect()
    return [[whole(x, scale) for x in r["vec"]] for r in first]


def cluster(
    vectors: DataFrame, k: int = 40, rounds: int = 5, seed: str = "2", key: str = "vec_id", embedding: str = "embedding", width: int = WIDTH, scale: int = SCALE, lead: int = LEAD
) -> tuple[DataFrame, list[list[int]]]:
    """Every kept vector with its ``cluster`` and squared ``distance``, and the final centroids.

    Vectors with another number of components, or with null or non-finite ones, are left out; the others
    become floor(scale * x). Fewer than ``k`` vectors give as many centroids; an empty table none and no
    rows. Null and repeated keys count like any other row. Equal distances go to the smaller cluster.
    Whole numbers of any size are exact; distances past 64 bits are given as the largest 64-bit number.
    Other columns are not read, whatever their names. A round is one scan of the rotated table in the
    shared folder and a sum over clusters; only centroids (k * width numbers) pass the driver.
    """
    kept = cut_lineage(kept_vectors(vectors, key, embedding, width))
    centroids = first_centroids(kept, k, seed, key, scale)
    schema = f"`{key}` {kept.schema[key].dataType.simpleString()}, cluster int, distance bigint"
    if not centroids:
        return kept.sparkSession.createDataFrame([], schema), []
    rotation = Rotation(*moments(kept, width, scale), lead)
    table = cut_lineage(rotated_table(kept, rotation, key, scale))
    for _ in range(rounds):
        for number, (n, sums) in cluster_sums(table, Nearest(centroids, rotation), scale).items():
            centroids[number] = [s // n for s in sums]
    nearest = Nearest(centroids, rotation)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, clusters, distances, _ in assigned(batch, nearest, scale):
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows)), pa.array(clusters), pa.array(distances)], names=[key, "cluster", "distance"])

    return table.mapInArrow(assign, schema), centroids


def cluster_report(vectors: DataFrame, key: str = "vec_id", **options) -> DataFrame:
    """``cluster``'s rows with cluster_inertia, inertia (sums of distance) and centroid_sha256 of the final centroid."""
    found, centroids = cluster(vectors, key=key, **options)
    found = cut_lineage(found)
    shas = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    sums = {r["cluster"]: int(r["s"]) for r in found.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()}
    rows = [(k, min(s, LARGEST), min(sum(sums.values()), LARGEST), shas[k]) for k, s in sums.items()]
    per_cluster = found.sparkSession.createDataFrame(rows, "cluster int, cluster_inertia bigint, inertia bigint, centroid_sha256 string")
    return found.join(F.broadcast(per_cluster), "cluster").select(key, "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
