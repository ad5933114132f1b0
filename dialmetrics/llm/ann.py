"""Nearest neighbours by a block matrix join with int8 tiles.

A stated query set is searched against all rows. Queries and rows are hashed
into blocks of a bounded size; a tile is a pair (query block, row block), and
one shuffle brings the two blocks of a tile together (rows once for each query
block, queries once for each row block). In a tile:

1. unit vectors are quantised to int8, ``u = s * q + e``, and ``|e|`` is kept;
2. one integer matrix product gives all cosines up to
   ``|e_u| + (1 + |e_u|) * |e_v|``;
3. per query the k-th largest lower bound is a floor, and only pairs whose upper
   bound reaches it survive: no true neighbour can be pruned;
4. survivors are recomputed in double precision on the original vectors and a
   heap of size k per query is emitted.

A window with row numbers merges the heaps (Spark prunes to k per query before
the shuffle). The result is exact. Equal vectors within a tile are cut to their
k + 1 smallest ids, which can change no result, so that a vector that a third
of all rows share costs no more than k + 1 rows a tile.

Defined results: vectors that are null, empty, zero or that hold a null or
non-finite component are neither queries nor candidates; vectors of another
length than the query's are no candidates; rows that repeat an id count as one
(as a query the smallest vector, as candidates the nearest); an empty table gives an empty table.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

QUERY_BLOCK = 2048      # queries a tile, on average
ROW_BLOCK = 4096        # rows a tile, on average
SLACK = 1e-6            # float32 rounding of the scaled integer products
DIMS_EXACT = 1040       # 127 * 127 * 1040 < 2 ** 24: integers that float32 holds


def usable(table: pa.Table) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Ids and original vectors (double) by length; unusable vectors are left out."""
    out: dict[int, tuple[list, list]] = {}
    for batch in table.to_batches():
        ids, vectors = batch.column("id"), batch.column("v")
        lengths = pa.compute.list_value_length(vectors).fill_null(0).to_numpy(zero_copy_only=False)
        known = ~ids.is_null().to_numpy(zero_copy_only=False)
        for d in np.unique(lengths[lengths > 0]):
            at = np.flatnonzero((lengths == d) & known)
            flat = vectors.take(pa.array(at)).flatten().cast(pa.float64())
            rows = flat.fill_null(float("nan")).to_numpy(zero_copy_only=False).reshape(len(at), d)
            good = np.isfinite(rows).all(axis=1) & (rows != 0).any(axis=1)
            out.setdefault(int(d), ([], []))[0].append(ids.to_numpy(zero_copy_only=False)[at][good].astype(np.int64))
            out[int(d)][1].append(rows[good])
    return {d: (np.concatenate(i), np.concatenate(v)) for d, (i, v) in out.items()}


def fewest(ids: np.ndarray, rows: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Without repeated (id, vector) rows and with the k smallest ids of equal vectors."""
    if not len(ids):
        return ids, rows
    key = np.ascontiguousarray(rows).view(np.dtype((np.void, rows.shape[1] * 8))).ravel()
    kind = np.unique(key, return_inverse=True)[1].ravel()
    order = np.lexsort((ids, kind))
    ids, rows, kind = ids[order], rows[order], kind[order]
    new = np.r_[True, (kind[1:] != kind[:-1]) | (ids[1:] != ids[:-1])]
    ids, rows, kind = ids[new], rows[new], kind[new]
    starts = np.flatnonzero(np.r_[True, kind[1:] != kind[:-1]])
    place = np.arange(len(kind)) - np.repeat(starts, np.diff(np.r_[starts, len(kind)]))
    return ids[place < k], rows[place < k]


def quantise(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """int8 codes, scales and the norms of what quantising the unit vectors leaves."""
    top = np.abs(rows).max(axis=1, keepdims=True)
    unit = rows / top
    unit /= np.sqrt((unit * unit).sum(axis=1, keepdims=True))
    scale = np.abs(unit).max(axis=1) / 127.0
    codes = np.rint(unit / scale[:, None]).astype(np.int8)
    left = unit - codes * scale[:, None]
    return codes, scale, np.sqrt((left * left).sum(axis=1))


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Integer products of int8 rows; float32 carries them exactly, some dimensions at a time."""
    total = None
    for d in range(0, a.shape[1], DIMS_EXACT):
        part = a[:, d:d + DIMS_EXACT].astype(np.float32) @ b[:, d:d + DIMS_EXACT].astype(np.float32).T
        total = part if total is None else total.astype(np.float64) + part
    return total


def cosines(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Cosines of paired rows in double precision."""
    return (x * y).sum(axis=1) / (np.sqrt((x * x).sum(axis=1)) * np.sqrt((y * y).sum(axis=1)))


def tile(q_ids: np.ndarray, q: np.ndarray, ids: np.ndarray, rows: np.ndarray, k: int,
         step: int = 256) -> Iterator[tuple[int, int, float]]:
    """The k nearest rows of each query, as (query id, id, cosine)."""
    ids, rows = fewest(ids, rows, k + 1)
    if not len(ids) or not len(q_ids):
        return
    codes, scale, left = quantise(rows)
    for a in range(0, len(q_ids), step):
        own, x = q_ids[a:a + step], q[a:a + step]
        c, s, e = quantise(x)
        near = products(c, codes) * s[:, None] * scale[None, :]
        bound = e[:, None] + (1 + e[:, None]) * left[None, :] + SLACK
        near[own[:, None] == ids[None, :]] = -np.inf
        lower = near - bound
        floor = (np.partition(lower, -k, axis=1)[:, -k] if lower.shape[1] > k
                 else np.full(len(own), -np.inf))
        i, j = np.nonzero((near + bound >= floor[:, None]) & np.isfinite(near))
        ends = np.searchsorted(i, np.arange(len(own) + 1))
        score = np.concatenate([cosines(x[i[b:b + 65536]], rows[j[b:b + 65536]])
                                for b in range(0, len(i), 65536)] or [np.zeros(0)])
        for n in range(len(own)):
            heap: dict[int, float] = {}
            for v, w in zip(ids[j[ends[n]:ends[n + 1]]].tolist(), score[ends[n]:ends[n + 1]].tolist(), strict=True):
                heap[v] = max(w, heap.get(v, -2.0))
            for v, w in heapq.nsmallest(k, heap.items(), key=lambda z: (-z[1], z[0])):
                yield int(own[n]), v, w


def nearest(rows: DataFrame, is_query: Column, k: int = 5, id: str = "vec_id", vector: str = "embedding",
            query_block: int = QUERY_BLOCK, row_block: int = ROW_BLOCK) -> DataFrame:
    """``query_id, rank, vec_id, score``: the k rows with the largest cosine for each query."""
    base = (rows.select(F.col(id).cast("long").alias("id"), F.col(vector).alias("v"), is_query.alias("is_q"))
            .where(F.col("id").isNotNull() & F.col("v").isNotNull()))
    size = base.agg(F.count(F.lit(1)).alias("n"), F.count_if("is_q").alias("q")).first()
    qs, ds = max(1, math.ceil(size["q"] / query_block)), max(1, math.ceil(size["n"] / row_block))
    each_q = F.explode(F.sequence(F.lit(0), F.lit(qs - 1)))
    each_d = F.explode(F.sequence(F.lit(0), F.lit(ds - 1)))
    hashed = lambda n, seed: F.pmod(F.xxhash64(F.lit(seed), "id"), F.lit(n)).cast("int")
    left = base.where("is_q").select("id", "v", hashed(qs, "q").alias("qb")).withColumn("db", each_d)
    right = base.select("id", "v", hashed(ds, "d").alias("db")).withColumn("qb", each_q)

    def search(a: pa.Table, b: pa.Table) -> pa.Table:
        queries, data, found = usable(a), usable(b), []
        for d, (q_ids, q) in queries.items():
            order = np.lexsort((*q.T[::-1], q_ids))
            q_ids, q = q_ids[order], q[order]
            q_ids, first = np.unique(q_ids, return_index=True)
            if d in data:
                found += tile(q_ids, q[first], *data[d], k)
        cols = list(zip(*found, strict=True)) or [(), (), ()]
        return pa.table({"query_id": pa.array(cols[0], pa.int64()), "vec_id": pa.array(cols[1], pa.int64()),
                         "score": pa.array(cols[2], pa.float64())})

    heaps = (left.groupBy("qb", "db").cogroup(right.groupBy("qb", "db"))
             .applyInArrow(search, "query_id long, vec_id long, score double"))
    merged = heaps.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), F.col("vec_id"))
    return (merged.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score"))
