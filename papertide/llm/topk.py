"""Exact top-k inner products with block-at-a-time pruning.

Vectors are ordered by their nearest of a few pivots and cut into ranges of ``block`` documents;
a block keeps its forward index (the integer matrix) and, per dimension ("term"), its least and
greatest value. A query's bound for a block is the sum over dimensions of the larger product with
the two. Each query visits its blocks from the highest bound down and stops where the bound falls
below its k-th score. Queries go in chunks of bounded size against all blocks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from papertide.llm.common import written

#: Queries that are sent to all executors at once (32 MB at 64 dimensions).
QUERY_CHUNK = 65536
#: Index blocks that one task holds at a time.
BLOCKS_AT_ONCE = 256


def quantised(vectors: DataFrame, vec: str = "embedding", scale: int = 256) -> DataFrame:
    """vec_id, dim, v (array of floor(scale * component)); rows without an id, null or empty vectors
    and those that hold a null or non-finite component are left out."""
    x = F.col(vec).cast("array<double>")
    good = F.forall(x, lambda c: F.coalesce(~F.isnan(c) & (F.abs(c) < float("inf")), F.lit(False)))
    rows = vectors.filter(F.col("vec_id").isNotNull() & (F.size(x) > 0) & good)
    return rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.size(x).alias("dim"), F.transform(x, lambda c: F.floor(c * scale).cast("double")).alias("v"))


def _near(pivots: dict[int, np.ndarray]):
    """Adds the nearest pivot of each vector."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            dims, flat = b["dim"].to_numpy(), b["v"].flatten().to_numpy()
            at = np.cumsum(dims) - dims
            out = np.zeros(b.num_rows, np.int32)
            for d in np.unique(dims):
                own = np.flatnonzero(dims == d)
                if d in pivots:
                    m = flat[at[own][:, None] + np.arange(d)]
                    p = pivots[d]
                    out[own] = np.argmin((p**2).sum(1)[None] - 2 * m @ p.T, axis=1)
            yield pa.RecordBatch.from_arrays([b["vec_id"], b["dim"], pa.array(out), b["v"]], ["vec_id", "dim", "near", "v"])

    return run


def _blocks(block: int):
    """Rows sorted by (dim, near, vec_id) -> one row a block: ids, matrix and per-dimension extremes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            dims, near = b["dim"].to_numpy(), b["near"].to_numpy()
            flat, at, ids = b["v"].flatten().to_numpy(), np.cumsum(dims) - dims, b["vec_id"].to_numpy()
            edge = np.flatnonzero((np.diff(dims) != 0) | (np.diff(near) != 0)) + 1
            spans = [(i, min(i + block, e)) for s, e in zip([0, *edge], [*edge, len(dims)], strict=True) for i in range(s, e, block)]
            out = []
            for s, e in spans:
                m = flat[at[s] : at[s] + (e - s) * dims[s]].reshape(e - s, dims[s])
                out.append((int(dims[s]), ids[s:e].tobytes(), m.tobytes(), m.min(0).tobytes(), m.max(0).tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*out, strict=True)], ["dim", "ids", "matrix", "low", "high"])

    return run


def build_index(rows: DataFrame, block: int = 128, pivots: int = 64) -> DataFrame:
    """Blocks of quantised rows. Pivots are a bounded sample: the ``pivots`` rows of least id hash."""
    heads = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(pivots).collect()
    by_dim = {d: np.array([r["v"] for r in heads if r["dim"] == d]) for d in {r["dim"] for r in heads}}
    near = rows.mapInArrow(_near(by_dim), "vec_id long, dim int, near int, v array<double>")
    return near.repartitionByRange("dim", "near", "vec_id").sortWithinPartitions("dim", "near", "vec_id").mapInArrow(
        _blocks(block), "dim long, ids binary, matrix binary, low binary, high binary"
    )


def search_blocks(q: np.ndarray, own: np.ndarray, blocks: list[tuple], k: int) -> tuple[np.ndarray, np.ndarray]:
    """Best ``k`` (scores, ids) of each query over the blocks; unused places hold -inf."""
    score, ident = np.full((len(q), k), -np.inf), np.full((len(q), k), np.iinfo(np.int64).max)
    if not len(q) or not blocks:
        return score, ident
    low, high = (np.array([b[i] for b in blocks]) for i in (2, 3))
    bound = np.maximum(q, 0) @ high.T + np.minimum(q, 0) @ low.T
    order = np.argsort(-bound, axis=1, kind="stable")
    active = np.arange(len(q))
    for step in range(len(blocks)):
        at = order[active, step]
        open_ = bound[active, at] >= score[active, k - 1]
        active, at = active[open_], at[open_]
        if not len(active):
            break
        by = np.argsort(at, kind="stable")
        cut = np.flatnonzero(np.diff(at[by])) + 1
        for group in np.split(by, cut):
            rows, b = active[group], blocks[at[group[0]]]
            s = q[rows] @ b[1].T
            s[b[0][None] == own[rows][:, None]] = -np.inf
            if s.shape[1] > k:
                kth = np.partition(s, s.shape[1] - k, axis=1)[:, -k][:, None]
                better = s >= np.maximum(kth, score[rows, k - 1][:, None])
            else:
                better = s >= score[rows, k - 1][:, None]
            better &= s > -np.inf
            for i in np.flatnonzero(better.any(1)):
                r = rows[i]
                all_s = np.concatenate([score[r], s[i][better[i]]])
                all_i = np.concatenate([ident[r], b[0][better[i]]])
                best = np.lexsort((all_i, -all_s))[:k]
                score[r], ident[r] = all_s[best], all_i[best]
    return score, ident


def _search(shared, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries = shared.value
        best = {d: search_blocks(m, ids, [], k) for d, (ids, m) in queries.items()}
        for batch in batches:
            for lo in range(0, batch.num_rows, BLOCKS_AT_ONCE):
                held: dict[int, list] = {}
                for r in batch.slice(lo, BLOCKS_AT_ONCE).to_pylist():
                    ids = np.frombuffer(r["ids"], np.int64)
                    held.setdefault(r["dim"], []).append((ids, np.frombuffer(r["matrix"]).reshape(len(ids), -1), np.frombuffer(r["low"]), np.frombuffer(r["high"])))
                for d, blocks in held.items():
                    if d in queries:
                        s, i = search_blocks(queries[d][1], queries[d][0], blocks, k)
                        s, i = np.hstack([best[d][0], s]), np.hstack([best[d][1], i])
                        top = np.lexsort((i, -s), axis=1)[:, :k]
                        best[d] = np.take_along_axis(s, top, 1), np.take_along_axis(i, top, 1)
        for d, (s, i) in best.items():
            row, col = np.nonzero(s > -np.inf)
            if len(row):
                cols = [queries[d][0][row], i[row, col], s[row, col].astype(np.int64)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], ["query_id", "vec_id", "score"])

    return run


def exact_topk(vectors: DataFrame, is_query: Column, k: int = 5, vec: str = "embedding", query_chunk: int = QUERY_CHUNK, block: int = 128) -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` highest integer inner products of each query row over
    all rows but those of its own id; ties go to the smaller vec_id.

    Vectors of another length are no candidates of a query. Repeated rows count once. An id with
    several different vectors is several candidates, and its least vector is the query. Exact
    while inner products stay below 2^53. Only a query chunk (at most ``query_chunk`` rows in
    expectation) is broadcast; chunk after chunk goes over the written index.
    """
    spark = vectors.sparkSession
    rows = written(quantised(vectors, vec).distinct(), "vectors")
    index = written(build_index(rows, block), "vector-blocks")
    queries = written(rows.filter(is_query).groupBy("vec_id").agg(F.min("v").alias("v")), "queries")
    chunks = max(1, -(-queries.count() // query_chunk))
    found = None
    for c in range(chunks):
        held = queries.filter(F.pmod(F.xxhash64("vec_id"), F.lit(chunks)) == c).toPandas()
        dims = held["v"].map(len).to_numpy()
        packed = {int(d): (held["vec_id"].to_numpy(np.int64)[dims == d], np.array(held["v"][dims == d].tolist(), float)) for d in set(dims.tolist())}
        shared = spark.sparkContext.broadcast(packed)
        part = written(index.mapInArrow(_search(shared, k), "query_id long, vec_id long, score long"), "hits")
        found = part if found is None else found.unionByName(part)
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
