"""Operator 2: exact top-k search by inner product, by a three-phase uniform threshold.

A score is the sum of the partial scores of ``lists`` slices of the dimensions; each data
partition holds one score list a slice for each query.

1. Gather: every partition scores exactly the k best entries of each of its lists and
   reports, for each query, the k best of those rows.
2. Broadcast: the k-th best of all reported scores is a safe cutoff, as k rows reach it.
   A row can reach it only if on some list its partial score is at least the uniform share,
   the cutoff divided by the number of lists.  Partitions sort each slice of their rows once,
   by length: no entry of a row shorter than the share by the query's own length can reach
   the share (Cauchy-Schwarz), so only the rows before that point are scored, and of those
   the entries at or above their share are collected.
3. Resolve: only for collected entries the partial scores of the other slices are fetched and
   added, exactly; those that reach the cutoff, at most k a partition and query by score and
   then smaller id, go to one ranking of each query.

Vectors are quantised to whole numbers, once, so scores are exact: in doubles while products
stay below 2**53, else in Python integers (scores beyond a long are held at its limits).

Queries come in blocks of at most about ``block`` vectors, one pass over the table each;
only a block, its cutoffs and nothing else is broadcast, so the size is bounded by
``block * dimensions * 8`` bytes.

Cases: vectors that are null, empty, or hold null or non-finite components take no part, nor
do rows without an id; vectors only meet vectors of their own length; rows that repeat an id
are candidates each, but an id asks once (with its first vector in array order) and never
finds itself; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise, work_dir

EXACT = float(1 << 53)
_LONG = (1 << 63) - 1
#: Scores held at a time.
_CELLS = 1 << 22


def quantise(embedding: Column, scale: int = 1024) -> Column:
    """floor(scale * x) of each component as doubles; null for vectors that take no part."""
    x = F.transform(embedding, lambda v: v.cast("double"))
    fine = (F.size(x) > 0) & F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    # Beyond 2**53 a double is whole already, and floor() to a long would overflow.
    return F.when(fine, F.transform(x, lambda v: F.when(F.abs(v) < 2.0**42, F.floor(v * scale).cast("double")).otherwise(v * scale)))


def _exact(q: np.ndarray, x: np.ndarray) -> bool:
    """Whether doubles hold every sum of products."""
    return float(np.abs(q).max(initial=0)) * float(np.abs(x).max(initial=0)) * q.shape[1] < EXACT


def _whole(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """All scores as longs by way of Python integers; what exceeds a long is held at its limits."""
    a, b = (np.array([[int(v) for v in r] for r in m], dtype=object).reshape(m.shape) for m in (q, x))
    return np.clip(a @ b.T, -_LONG, _LONG).astype(np.int64)


def _matrix(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Flat values and lengths of a list column."""
    return col.flatten().to_numpy(zero_copy_only=False), np.diff(col.offsets.to_numpy())


def _by_length(ids: pa.Array, vectors: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    flat, sizes = _matrix(vectors)
    starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    ids = ids.to_numpy(zero_copy_only=False)
    for d in np.unique(sizes):
        at = np.flatnonzero(sizes == d)
        yield int(d), ids[at], flat[(starts[at][:, None] + np.arange(d)[None, :])]


def _slices(d: int, lists: int) -> list[slice]:
    edges = np.linspace(0, d, min(lists, d) + 1).astype(int)
    return [slice(a, b) for a, b in zip(edges, edges[1:])]


def _parts(queries: int, rows: int) -> Iterator[slice]:
    step = max(1, _CELLS // max(1, rows))
    for at in range(0, queries, step):
        yield slice(at, min(queries, at + step))


def _scores(q: np.ndarray, x: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Exact scores of the pairs (query i, row j)."""
    step = max(1, _CELLS // q.shape[1])
    return np.concatenate([np.einsum("pd,pd->p", q[i[at : at + step]], x[j[at : at + step]]) for at in range(0, len(i), step)] or [np.empty(0)])


def _own(qids: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places (query, row) where a query would find itself; ``qids`` is sorted."""
    at = np.minimum(np.searchsorted(qids, ids), len(qids) - 1)
    rows = np.flatnonzero(qids[at] == ids)
    return at[rows], rows


def _gather(queries: dict, k: int, lists: int):
    """Phase 1."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        top = {d: np.full((len(ids), k), -np.inf) for d, (ids, _) in queries.items()}
        for batch in batches:
            for d, ids, x in _by_length(batch.column(0), batch.column(1)):
                if d not in queries or not _exact(queries[d][1], x):
                    continue  # rows beyond doubles report nothing, which only makes the cutoff lower
                qids, q = queries[d]
                own_q, own_row = _own(qids, ids)
                for part in _parts(len(qids), len(ids)):
                    mine = (own_q >= part.start) & (own_q < part.stop)
                    near = []
                    for s in _slices(d, lists):
                        p = q[part, s] @ x[:, s].T
                        p[own_q[mine] - part.start, own_row[mine]] = -np.inf
                        near.append(np.argpartition(p, len(ids) - k, axis=1)[:, -k:] if len(ids) > k else np.broadcast_to(np.arange(len(ids)), p.shape))
                    near = np.sort(np.concatenate(near, axis=1), axis=1)
                    score = _scores(q[part], x, np.repeat(np.arange(len(near)), near.shape[1]), near.ravel()).reshape(near.shape)
                    score[:, 1:][near[:, 1:] == near[:, :-1]] = -np.inf
                    score[ids[near] == qids[part][:, None]] = -np.inf
                    held = np.concatenate([top[d][part], score], axis=1)
                    top[d][part] = np.partition(held, held.shape[1] - k, axis=1)[:, -k:]
        for d, held in top.items():
            i, j = np.nonzero(held > -np.inf)
            yield pa.RecordBatch.from_arrays([pa.array(queries[d][0][i]), pa.array(held[i, j].astype(np.int64))], names=["query_id", "score"])

    return run


def _collect(q: np.ndarray, x: np.ndarray, cutoff: np.ndarray, by_length: list[tuple[slice, np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray] | None:
    """Phase 2: the pairs that reach their share on some list; None if they are so many that scoring all is cheaper."""
    share, n = np.ceil(cutoff / len(by_length)), len(x)
    found = []
    for s, order, length in by_length:
        reach = np.sqrt(np.square(q[:, s]).sum(axis=1)) * (1 + 1e-9)
        with np.errstate(divide="ignore", invalid="ignore"):
            least = np.where(share > 0, share / reach, 0.0)
        rows = order[: np.searchsorted(-length, -least.min() * (1 - 1e-9), side="right")]
        if not len(rows):
            continue
        i, j = np.nonzero(q[:, s] @ x[rows, s].T >= share[:, None])
        found.append(i * n + rows[j])
        if sum(map(len, found)) * 4 > len(q) * n:
            return None
    pairs = np.unique(np.concatenate(found)) if found else np.empty(0, dtype=np.int64)
    return pairs // n, pairs % n


def _best(query: np.ndarray, score: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of each query's k highest scores, ties to smaller ids."""
    order = np.lexsort((ids, -score, query))
    sorted_q = query[order]
    first = np.searchsorted(sorted_q, sorted_q)
    return order[np.arange(len(order)) - first < k]


def _resolve(queries: dict, cutoffs: dict, k: int, lists: int):
    """Phases 2 and 3."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        top = {d: (np.empty(0, np.int64),) * 3 for d in queries}
        for batch in batches:
            for d, ids, x in _by_length(batch.column(0), batch.column(1)):
                if d not in queries:
                    continue
                qids, q = queries[d]
                cutoff, found = cutoffs[d], [top[d]]
                exact, by_length = _exact(q, x), []
                for s in _slices(d, lists) if exact else ():
                    length = np.sqrt(np.square(x[:, s]).sum(axis=1))
                    order = np.argsort(-length, kind="stable")
                    by_length.append((s, order, length[order]))
                for part in _parts(len(qids), len(ids)):
                    cut = cutoff[part]
                    if exact and (pairs := _collect(q[part], x, cut, by_length)) is not None:
                        i, j = pairs
                        score = _scores(q[part], x, i, j)
                        fine = score >= cut[i]
                        i, j, score = i[fine], j[fine], score[fine]
                    else:
                        every = q[part] @ x.T if exact else _whole(q[part], x)
                        i, j = np.nonzero(every >= cut[:, None])
                        score = every[i, j]
                    other = ids[j] != qids[part][i]
                    found.append((i[other] + part.start, score[other].astype(np.int64), ids[j[other]]))
                query, score, near = (np.concatenate(c) for c in zip(*found))
                best = _best(query, score, near, k)
                top[d] = query[best], score[best], near[best]
        for d, (query, score, near) in top.items():
            if len(query):
                yield pa.RecordBatch.from_arrays([pa.array(queries[d][0][query]), pa.array(near), pa.array(score)], names=["query_id", "vec_id", "score"])

    return run


def top_k(vectors: DataFrame, is_query: Column, k: int = 10, lists: int = 4, scale: int = 1024, block: int = 4096, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank (from 1), vec_id, score: each query's k highest inner products among all rows but its own."""
    spark, where = vectors.sparkSession, work_dir(vectors.sparkSession, "topk")
    usable = vectors.select(F.col(id_col).cast("long").alias("vec_id"), quantise(F.col(vector_col), scale).alias("v"), is_query.alias("q")).where("vec_id IS NOT NULL AND v IS NOT NULL")
    usable = materialise(usable, f"{where}/vectors")
    data = usable.select("vec_id", "v")
    asked = materialise(usable.where("q").groupBy("vec_id").agg(F.min("v").alias("v")), f"{where}/queries")
    blocks = max(1, -(-asked.count() // block))
    results = None
    for b in range(blocks):
        # A hashed block of about ``block`` queries: bounded, whatever the table holds.
        part = asked.where(F.pmod(F.xxhash64("vec_id"), F.lit(blocks)) == b).toArrow()
        queries = _merged(part)
        reported = data.mapInArrow(_gather(queries, k, lists), "query_id long, score long")
        nth = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score")))
        safe = {r["query_id"]: r["score"] for r in reported.withColumn("nth", nth).where(F.col("nth") <= k).where(F.col("nth") == k).collect()}  # a row for each query of the block
        cutoffs = {d: np.array([safe.get(int(i), -np.inf) for i in ids], dtype=float) for d, (ids, _) in queries.items()}
        found = data.mapInArrow(_resolve(queries, cutoffs, k, lists), "query_id long, vec_id long, score long")
        rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
        ranked = found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
        ranked.write.mode("append").parquet(f"{where}/found")
        results = spark.read.schema(ranked.schema).parquet(f"{where}/found")
    return results


def _merged(part: pa.Table) -> dict:
    """Queries by length of vector: ids in order, and their matrix."""
    part = part.combine_chunks()
    out = {}
    if part.num_rows:
        for d, ids, x in _by_length(part.column(0).chunk(0), part.column(1).chunk(0)):
            order = np.argsort(ids)
            out[d] = ids[order].astype(np.int64), x[order]
    return out
