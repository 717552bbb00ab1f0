"""Exact top-k search by inner product with block-at-a-time pruning (operator 9)."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumeflux.session import cut_lineage

BLOCK_ROWS = 128
SHARD_ROWS = 16_384
QUERY_ROWS = 512
PIVOTS = 64
PLACE = "__place"


def integer_vectors(vectors: DataFrame, key: str = "vec_id", embedding: str = "embedding", scale: int = 256) -> DataFrame:
    """``key``, ``vec``, floor(scale * x) of each component, and a number that tells rows of one key apart (once written).

    Vectors that are null or hold null or non-finite components are left out.
    """
    x = F.col(embedding)
    bad = F.exists(x, lambda v: v.isNull() | F.isnan(v.cast("double")) | (F.abs(v.cast("double")) == F.lit(float("inf"))))
    rows = vectors.where(x.isNotNull()).where(~bad)
    vec = F.transform(x, lambda v: F.floor(v.cast("double") * F.lit(float(scale))).cast("double"))
    return rows.select(F.col(key), vec.alias("vec"), F.monotonically_increasing_id().alias(PLACE))


def _matrix(vectors: pd.Series) -> np.ndarray:
    """Rows as float64; shorter vectors count as continued with zeros."""
    width = max((len(v) for v in vectors), default=0)
    if all(len(v) == width for v in vectors):
        return np.array(vectors.tolist(), np.float64).reshape(len(vectors), width)
    out = np.zeros((len(vectors), width))
    for k, v in enumerate(vectors):
        out[k, : len(v)] = v
    return out


def _products(block: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Exact inner products; sums that leave the exact range of doubles are made with whole numbers, within 64 bits."""
    width = min(block.shape[1], len(query))
    block, query = block[:, :width], query[:width]
    if width == 0:
        return np.zeros(len(block), np.int64)
    if np.abs(block).max(initial=0) * np.abs(query).max(initial=0) * width < 2**53:
        return (block @ query).astype(np.int64)
    q = [int(v) for v in query]
    sums = [sum(int(a) * b for a, b in zip(row, q)) for row in block]
    return np.array([max(-(2**63), min(2**63 - 1, s)) for s in sums], np.int64)


def _near(pivots: np.ndarray):
    """Number of the pivot with the largest product: rows of a block should look alike, for tight bounds."""

    def run(batches):
        for pdf in batches:
            if len(pdf) == 0:
                continue
            m = _matrix(pdf["vec"])
            width = min(m.shape[1], pivots.shape[1])
            near = (m[:, :width] @ pivots[:, :width].T).argmax(1) if len(pivots) and width else np.zeros(len(m), np.int64)
            yield pdf.assign(near=near.astype(np.int64))

    return run


def build_blocks(vectors: DataFrame, key: str = "vec_id", block_rows: int = BLOCK_ROWS, shard_rows: int = SHARD_ROWS, pivots: int = PIVOTS) -> DataFrame:
    """Forward index in blocks: shard, ids, places, vectors (row-major doubles), largest and smallest value of each component.

    Rows are grouped with their nearest pivot (a bounded sample of vectors, at most ``pivots``), ranges of
    equal pivots being cut into shards of about ``shard_rows`` rows and blocks of ``block_rows``. Pivots
    decide only how tight the bounds are, never the result. Every row is indexed.
    """
    sample = vectors.orderBy(F.xxhash64(F.col(key)), F.xxhash64("vec")).limit(pivots).toPandas()
    near = vectors.mapInPandas(_near(_matrix(sample["vec"])), f"`{key}` {vectors.schema[key].dataType.simpleString()}, vec array<double>, {PLACE} bigint, near bigint")
    near = cut_lineage(near)
    shards = max(1, -(-near.count() // shard_rows))
    deal = F.pmod(F.xxhash64(F.col(key), F.col("vec")), F.lit(shards))
    # equal rows would share a hash: their row numbers deal them out
    shard = F.pmod(deal + F.monotonically_increasing_id(), F.lit(shards)) if shards > 1 else F.lit(0).cast("bigint")

    def cut(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["near", key], kind="stable")
        rows = []
        for at in range(0, len(pdf), block_rows):
            part = pdf.iloc[at : at + block_rows]
            m = _matrix(part["vec"])
            ids = part[key].astype("Int64")
            rows.append((int(pdf["shard"].iloc[0]), ids.tolist(), part[PLACE].tolist(), m.tobytes(), m.max(0).tobytes(), m.min(0).tobytes()))
        out = pd.DataFrame(rows, columns=["shard", "ids", "places", "data", "top", "low"])
        out["ids"] = [[None if v is pd.NA else v for v in ids] for ids in out["ids"]]
        return out

    schema = "shard bigint, ids array<bigint>, places array<bigint>, data binary, top binary, low binary"
    return near.withColumn("shard", shard).groupBy("shard").applyInPandas(cut, schema)


def search(queries: DataFrame, blocks: DataFrame, k: int = 5, key: str = "vec_id", query_rows: int = QUERY_ROWS) -> DataFrame:
    """query_id, rank, ``key``, score: the ``k`` best rows of the index for every query, ties to the smaller key.

    ``queries`` are rows of the indexed table; a query's own row is no candidate of it, other rows of its key
    are. Every row of ``queries`` has an answer of its own, also where keys repeat; null keys come last
    among equal scores; an empty index gives no rows. Every task holds one chunk of queries and one shard
    of blocks. A block's score is bounded by the summed maxima of its terms (for negative weights:
    minima); a query takes blocks by falling bound and stops below its k-th score so far (an equal bound
    may still hold a smaller key). A last window over k rows a shard merges.
    """
    chunks = max(1, -(-queries.count() // query_rows))
    shards = blocks.agg(F.max("shard")).first()[0]
    if shards is None:
        return queries.limit(0).select(F.col(key).alias("query_id"), F.lit(0).alias("rank"), F.col(key), F.lit(0).cast("bigint").alias("score"))
    chunk = F.pmod(F.xxhash64(F.col(key), F.col("vec")), F.lit(chunks))
    left = queries.select(F.col(key), "vec", PLACE, chunk.alias("chunk")).withColumn("shard", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(shards).cast("bigint"))))
    right = blocks.withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(chunks - 1).cast("bigint"))))

    def score(q: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        out: list[tuple[int, int, int | None, int]] = []
        if len(q) and len(b):
            data = [np.frombuffer(d, np.float64).reshape(len(i), -1) for d, i in zip(b["data"], b["ids"])]
            ids = [np.array([np.iinfo(np.int64).max if v is None or v != v else int(v) for v in i], np.int64) for i in b["ids"]]
            places = [np.array(x, np.int64) for x in b["places"]]
            m = _matrix(q["vec"])
            width = max([m.shape[1], *(d.shape[1] for d in data)])
            top, low = np.zeros((len(b), width)), np.zeros((len(b), width))
            for r, (t, s) in enumerate(zip(b["top"], b["low"])):
                t, s = np.frombuffer(t, np.float64), np.frombuffer(s, np.float64)
                top[r, : len(t)], low[r, : len(s)] = t, s
            wide = np.zeros((len(m), width))
            wide[:, : m.shape[1]] = m
            bounds = np.maximum(wide, 0) @ top.T + np.minimum(wide, 0) @ low.T
            bounds += np.abs(bounds) * 1e-9  # never below the true bound, whatever was rounded
            for place, own, vec, bound in zip(q[PLACE].tolist(), q[key].astype("Int64").tolist(), m, bounds):
                best_s, best_i = np.zeros(0, np.int64), np.zeros(0, np.int64)
                for at in np.argsort(-bound, kind="stable"):
                    if len(best_s) == k and bound[at] < best_s[-1]:
                        break
                    s = _products(data[at], vec)
                    use = places[at] != place
                    if len(best_s) == k:
                        use &= s >= best_s[-1]
                    if not use.any():
                        continue
                    s, i = np.concatenate([best_s, s[use]]), np.concatenate([best_i, ids[at][use]])
                    order = np.lexsort((i, -s))[:k]
                    best_s, best_i = s[order], i[order]
                out += [(place, None if own is pd.NA else own, i if i != np.iinfo(np.int64).max else None, s) for s, i in zip(best_s.tolist(), best_i.tolist())]
        return pd.DataFrame({name: pd.array([r[n] for r in out], "Int64") for n, name in enumerate((PLACE, "query_id", key, "score"))})

    schema = f"{PLACE} bigint, query_id bigint, `{key}` bigint, score bigint"
    found = left.groupBy("chunk", "shard").cogroup(right.groupBy("chunk", "shard")).applyInPandas(score, schema)
    order = Window.partitionBy(PLACE).orderBy(F.col("score").desc(), F.col(key).asc_nulls_last())
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", key, "score")


def top_k(vectors: DataFrame, is_query: Column, k: int = 5, key: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """Index every valid row of ``vectors`` and search with the rows that ``is_query`` marks.

    Rows are told apart by a number they get when the integer vectors are written. Other columns are not read.
    """
    rows = cut_lineage(integer_vectors(vectors, key, embedding))
    blocks = cut_lineage(build_blocks(rows, key))
    return search(rows.where(is_query), blocks, k, key)
