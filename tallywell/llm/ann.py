"""Nearest neighbours by a block matrix join with int8 tiles.

Queries and candidates are dealt into blocks; each tile of the join is one query block against one candidate block. Inside
a tile, vectors are quantised to int8 with a scale each, and the product of the int8 blocks gives every inner product up to
a bound from the exact norms of the quantisation residuals (Cauchy-Schwarz). Only pairs whose upper bound reaches the k-th
best lower bound, or the k-th best score so far, are recomputed from the original vectors in double precision. A query's
best of each tile are merged by a heap, so the result is exact.

Vectors are scaled by a power of two each before they are quantised, so that bounds hold for components of any size; pairs whose
inner product might leave the range of doubles are all recomputed. Blocks have a bounded number of rows at any size of the table.
Defined results: vectors that are null, empty, zero, or hold null or non-finite components take no part, nor do rows without an
id; vectors of another length than the query's are no candidates of it; of rows that repeat an id each is a query and a candidate,
but none of a query of the same id; ties go to the smaller id; sums that leave the range of doubles are infinite, and those that
are no number come last; an empty table gives an empty table; other columns are not read.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from itertools import groupby
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows of a block of queries and of candidates at most (on average; rows are dealt by a hash of their id).
QUERY_BLOCK, CANDIDATE_BLOCK = 2048, 16384
#: Rows of a tile's inner steps: what bounds the memory of the product.
QUERY_STEP, CANDIDATE_STEP = 256, 4096


def usable(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """vec_id and `v` (array<double>) of the rows that take part."""
    v = vectors.select(vectors[key].cast("long").alias("vec_id"), vectors[vector].cast("array<double>").alias("v"))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return v.where(F.col("vec_id").isNotNull() & F.col("v").isNotNull() & F.coalesce(finite, F.lit(False)) & F.exists("v", lambda x: x != 0))


def scaled(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows whose largest component is between 1/2 and 1, and the powers of two that give the old ones."""
    e = np.frexp(np.abs(x).max(axis=1))[1].astype(np.int64)
    half = e // 2  # in two steps, as one factor might leave the range
    return np.ldexp(np.ldexp(x, -half[:, None]), (half - e)[:, None]), e


def quantised(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """int8 rows, their scales, the norms of the rounded rows, and the norms of what rounding lost."""
    scale = np.abs(x).max(axis=1) / 127
    q = np.rint(x / scale[:, None]).astype(np.int8)
    rounded = q * scale[:, None]
    return q, scale, np.linalg.norm(rounded, axis=1), np.linalg.norm(x - rounded, axis=1)


def int8_product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The exact integer product of int8 rows, given as float32: sums of up to 1024 products of int8 fit its mantissa, so BLAS can add them."""
    if a.shape[1] <= 1024:
        return a @ b.T
    out = np.zeros((len(a), len(b)))
    for at in range(0, a.shape[1], 1024):
        out += a[:, at : at + 1024] @ b[:, at : at + 1024].T
    return out


def exact(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of paired rows, added from the first component to the last."""
    total = np.zeros(len(a))
    for d in range(a.shape[1]):
        total += a[:, d] * b[:, d]
    return total


def kth(x: np.ndarray, k: int) -> np.ndarray:
    """The k-th largest of each row, or -inf if there are fewer."""
    return np.partition(x, x.shape[1] - k, axis=1)[:, x.shape[1] - k] if x.shape[1] >= k else np.full(len(x), -np.inf)


def tile(number: np.ndarray, qid: np.ndarray, qv: np.ndarray, cid: np.ndarray, cv: np.ndarray, k: int) -> Iterator[tuple[np.ndarray, ...]]:
    """For steps of queries: query numbers and ids, candidate ids and scores of each query's k best in this tile."""
    order = np.argsort(cid, kind="stable")
    cid, cv = cid[order], cv[order]
    c_scaled, c_power = scaled(cv)
    top = c_power.max()
    c8 = []
    for at in range(0, len(cid), CANDIDATE_STEP):
        c, *rest = quantised(c_scaled[at : at + CANDIDATE_STEP])
        c8.append((c.astype(np.float32), *rest, np.ldexp(1.0, c_power[at : at + CANDIDATE_STEP] - top)))
    with np.errstate(over="ignore", under="ignore", invalid="ignore"):
        for q0 in range(0, len(qid), QUERY_STEP):
            ids, v = qid[q0 : q0 + QUERY_STEP], qv[q0 : q0 + QUERY_STEP]
            q_scaled, q_power = scaled(v)
            q, scale, norm, lost = quantised(q_scaled)
            q = q.astype(np.float32)
            far = np.ldexp(1.0, np.minimum(1000 - q_power - top, 1023))  # beyond, in the scale of this tile, sums may leave the range
            near_zero = np.ldexp(1.0, np.minimum(-1000 - q_power - top, 1023))  # below, they may vanish
            best = (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))  # query's place, candidate id, score
            bar = np.full(len(ids), -np.inf)  # the k-th best score, in the scale of this tile
            for step, (c, c_scale, c_norm, c_lost, c_size) in enumerate(c8):
                own = cid[step * CANDIDATE_STEP : (step + 1) * CANDIDATE_STEP]
                # x.y - x'.y' = (x - x').y + x'.(y - y'), and |y| <= |y'| + |y - y'|; a little more for rounding of doubles
                near = int8_product(q, c) * (scale[:, None] * c_scale[None, :])
                off = (lost[:, None] * (c_norm + c_lost)[None, :] + norm[:, None] * c_lost[None, :]) * 1.0001 + 1e-12 * (norm[:, None] * c_norm[None, :])
                upper, lower = (near + off) * c_size, (near - off) * c_size
                size = ((norm + lost)[:, None] * (c_norm + c_lost)[None, :]) * c_size
                same = ids[:, None] == own[None, :]
                risky = size >= far[:, None]
                lower[same | risky] = -np.inf
                floor = np.maximum(bar, kth(lower, k))
                floor = np.where(np.abs(floor) <= near_zero, -near_zero, floor)
                rows, cols = np.nonzero(((upper >= floor[:, None]) | risky) & ~same)
                for at in range(0, len(rows), 65536):
                    r, m = rows[at : at + 65536], cols[at : at + 65536]
                    best = [np.concatenate(x) for x in zip(best, (r, own[m], exact(v[r], cv[step * CANDIDATE_STEP + m])))]
                    order = np.lexsort((best[1], -best[2], best[0]))
                    place = best[0][order]
                    rank = np.arange(len(place)) - np.searchsorted(place, place)
                    kept = order[rank < k]
                    best = [x[kept] for x in best]
                last = np.arange(len(best[0])) - np.searchsorted(best[0], best[0]) == k - 1
                held = best[0][last]
                # an infinite score says nothing of the others; rounding of the score is allowed for
                known = np.ldexp(np.ldexp(best[2][last], -(q_power[held] // 2)), -(q_power[held] - q_power[held] // 2) - top)
                bar[held] = np.where(np.isfinite(best[2][last]) & np.isfinite(known), known - 1e-12 * np.abs(known) - 1e-12 * norm[held], -np.inf)
            yield number[q0 : q0 + QUERY_STEP][best[0]], ids[best[0]], best[1], best[2]


def matrix(batch: pa.Table) -> np.ndarray:
    rows = batch.column("v").combine_chunks()
    return rows.flatten().to_numpy(zero_copy_only=False).reshape(len(rows), -1)


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 20, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """query_id, rank from 1, vec_id and score: the k candidates of largest inner product with each query, but for the query's own id.

    Both tables are counted first, to deal them into blocks; each block of queries is sent to each block of candidates.
    """
    spark = vectors.sparkSession
    c, q = usable(vectors, key, vector), usable(queries, key, vector)
    n_c, n_q = c.count(), q.count()
    cores = spark.sparkContext.defaultParallelism
    blocks_q = max(1, ceil(n_q / QUERY_BLOCK))
    blocks_c = max(1, ceil(n_c / CANDIDATE_BLOCK), ceil(min(4 * cores, n_c / 256) / blocks_q))

    def dealt(df: DataFrame, own: int, others: int, own_name: str, other_name: str, *more: str) -> DataFrame:
        every = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(others - 1).cast("long"))).alias(other_name)
        placed = df.withColumn(own_name, F.pmod(F.monotonically_increasing_id(), F.lit(own)))  # before the copies are made
        return placed.select(F.size("v").alias("dim"), own_name, "vec_id", "v", *more, every)

    left = dealt(q.withColumn("number", F.monotonically_increasing_id()), blocks_q, blocks_c, "qb", "cb", "number")
    right = dealt(c, blocks_c, blocks_q, "cb", "qb")
    schema = "number bigint, query_id bigint, vec_id bigint, score double"
    names = [x.split()[0] for x in schema.split(", ")]

    def join(queries: pa.Table, candidates: pa.Table) -> pa.Table:
        parts = []
        if queries.num_rows and candidates.num_rows:
            ids = (queries.column("number").to_numpy(), queries.column("vec_id").to_numpy(), matrix(queries), candidates.column("vec_id").to_numpy(), matrix(candidates))
            parts = list(tile(*ids, k))
        cols = [np.concatenate(x) for x in zip(*parts)] if parts else [*(np.empty(0, np.int64) for _ in range(3)), np.empty(0)]
        return pa.table(dict(zip(names, cols)))

    by = ["dim", "qb", "cb"]
    tiles = left.groupBy(*by).cogroup(right.groupBy(*by)).applyInArrow(join, schema)
    return merged(tiles, k)


def merged(tiles: DataFrame, k: int) -> DataFrame:
    """Each query's best of its tiles, by a heap of k. Rows come sorted by query, so one heap is held at a time."""

    def heaps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            for b in batches:
                yield from zip(*(b.column(c).to_pylist() for c in ("number", "query_id", "vec_id", "score")))

        out: list[tuple[int, int, int, float]] = []
        for _, own in groupby(rows(), key=lambda r: r[0]):
            best = heapq.nsmallest(k, own, key=lambda r: (r[3] != r[3], -r[3] if r[3] == r[3] else 0.0, r[2]))
            out += [(query, i, v, s) for i, (_, query, v, s) in enumerate(best, 1)]
            if len(out) >= 8192:
                yield batch(out)
                out = []
        if out:
            yield batch(out)

    def batch(rows: list[tuple[int, int, int, float]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.int32(), pa.int64(), pa.float64()))], names=["query_id", "rank", "vec_id", "score"])

    return tiles.repartition("number").sortWithinPartitions("number").mapInArrow(heaps, "query_id bigint, rank int, vec_id bigint, score double")
