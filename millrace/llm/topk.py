"""Exact top-k search by MaxScore over whole-number vectors.

A vector's components are its terms; a shard keeps a posting row for each dimension. A query's bound in a dimension is
the most that any vector of the shard can gain there. The bar is a score that the query's k-th best is known to reach:
the k-th best of the task's shards so far, of a sample of the shard, and of the least scores that the vectors still
competitive can end with. Dimensions are sorted by bound, and the tail whose bounds together stay below the bar is
non-essential: the essential postings are traversed in full, the others are probed in turn for the vectors whose score
and remaining bounds still reach the bar, which rises on the way. Tasks merge their shards' k best as they go, and the
tasks' k best are merged by query.

Queries are taken in blocks of bounded bytes, each against all rows by a job of its own, whose result is written.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import Workspace

#: Bytes of a block of queries, about, and queries in it at most; rows of a shard.
BLOCK_BYTES, QUERY_BLOCK, SHARD = 8 << 20, 16384, 8192
#: Below any score: no bar yet.
NONE = -(1 << 62)
#: Dimensions probed at a time.
STEP = 8


class Best:
    """The k best (score, vec id) found so far for each query of a block, ties to the smaller id."""

    def __init__(self, query_ids: np.ndarray, k: int):
        self.query_ids, self.k = query_ids, k
        self.scores = np.full((len(query_ids), k), NONE, np.int64)
        self.ids = np.zeros((len(query_ids), k), np.int64)

    def add(self, i: int, ids: np.ndarray, scores: np.ndarray) -> None:
        scores, ids = np.concatenate([self.scores[i], scores.astype(np.int64)]), np.concatenate([self.ids[i], ids])
        order = np.lexsort((ids, -scores))[: self.k]
        self.scores[i], self.ids[i] = scores[order], ids[order]

    def rows(self):
        """query ids, vec ids, scores."""
        found = self.scores > NONE
        return np.repeat(self.query_ids, found.sum(axis=1)), self.ids[found], self.scores[found]


def search_shard(ids: np.ndarray, vectors: np.ndarray, queries: np.ndarray, best: Best) -> None:
    """Merge a shard's rows into best; a query never finds rows of its own id."""
    top = max(int(np.abs(vectors).max(initial=0)), int(np.abs(queries).max(initial=0)))
    most = top * top * max(1, vectors.shape[1])
    if most >= 1 << 62:
        raise OverflowError(f"scores of components up to {top} may not fit a long")
    # sums of products stay whole in doubles below 2**53
    kind = np.float64 if most < 1 << 52 else np.int64
    k = best.k
    postings = np.ascontiguousarray(vectors.T.astype(kind))
    high, low = postings.max(axis=1), postings.min(axis=1)
    q = queries.astype(kind)
    most_gain, least_gain = np.maximum(q * high, q * low), np.minimum(q * high, q * low)
    by_bound = np.argsort(-most_gain, axis=1, kind="stable")
    sample = np.arange(0, len(ids), max(1, len(ids) // 256))
    sampled = q @ postings[:, sample]
    for i, own in enumerate(best.query_ids):
        def kth(scores, least=k):
            return np.partition(scores, len(scores) - least)[len(scores) - least] if len(scores) >= least else NONE

        bar = max(best.scores[i, -1], kth(sampled[i][ids[sample] != own]))
        dims = by_bound[i]
        tail = [np.concatenate([np.cumsum(g[i][dims][::-1])[::-1], [0]]) for g in (most_gain, least_gain)]
        below = np.flatnonzero(tail[0] < bar)
        essential = int(below[0]) if len(below) else len(dims)
        e = dims[:essential]
        score = q[i][e] @ postings[e]
        alive = np.flatnonzero((score + tail[0][essential] >= bar) & (ids != own))
        score = score[alive]
        for at in range(essential, len(dims), STEP):
            d, end = dims[at : at + STEP], min(at + STEP, len(dims))
            score = score + q[i][d] @ postings[np.ix_(d, alive)]
            bar = max(bar, kth(score + tail[1][end]))
            fit = score + tail[0][end] >= bar
            alive, score = alive[fit], score[fit]
        best.add(i, ids[alive], score)


def _pad(rows: list[bytes], dims: int) -> np.ndarray:
    out = np.zeros((len(rows), dims), np.int64)
    for i, r in enumerate(rows):
        x = np.frombuffer(r, "<i8")
        out[i, : len(x)] = x
    return out


def _search(sent, k: int):
    def run(batches):
        query_ids, queries, dims = sent.value
        best = Best(query_ids, k)
        for b in batches:
            for at in range(0, b.num_rows, SHARD):
                part = b.slice(at, SHARD)
                search_shard(part.column("vec_id").to_numpy(), _pad(part.column("v").to_pylist(), dims), queries, best)
        columns = [pa.array(c) for c in best.rows()]
        yield pa.RecordBatch.from_arrays(columns, ["query_id", "vec_id", "score"])

    return run


def _whole(batches):
    for b in batches:
        rows = [np.array(v, np.float64) for v in b.column(1).to_pylist()]
        if any(len(v) and np.abs(v).max() >= 1 << 30 for v in rows):
            raise OverflowError("a component of 2**30 or more gives scores beyond a long")
        data = [np.floor(256 * v).astype("<i8").tobytes() for v in rows]
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(data, pa.binary())], ["vec_id", "v"])


def top_k(vectors: DataFrame, space: Workspace, query_modulus: int = 50, k: int = 5) -> DataFrame:
    """query_id, rank, vec_id, score: each query's k highest inner products of floor(256 x) with other rows.

    vectors: vec_id, embedding. Rows whose vec_id or embedding is null, or whose embedding holds a null or non-finite
    component, take no part; missing trailing components count as 0; rows that share a vec_id are ranked each, and
    repeated query rows ask once (with the greatest of their embeddings, in the order of their bytes). Ties go to the
    smaller vec_id. An empty table gives an empty one. Scores that a long cannot hold are refused by an OverflowError.
    """
    good = vectors.where("vec_id is not null and embedding is not null").where(
        ~F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))))
    ints = space.save(good.select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>"))
                      .mapInArrow(_whole, "vec_id long, v binary"), "vectors")
    asked = ints.where(F.pmod("vec_id", F.lit(query_modulus)) == 0).groupBy("vec_id").agg(F.max("v").alias("v"))
    n, most = asked.count(), ints.agg(F.max(F.octet_length("v"))).first()[0]
    empty = ints.selectExpr("vec_id as query_id", "0 as rank", "vec_id", "0L as score").where("false")
    if not n:
        return empty
    sc = ints.sparkSession.sparkContext
    blocks = -(-n // max(1, min(QUERY_BLOCK, BLOCK_BYTES // max(8, most))))
    asked = space.save(asked.select("vec_id", "v", F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).alias("block")), "asked")
    by = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    for block in range(blocks):
        rows = asked.where(F.col("block") == block).collect()  # some BLOCK_BYTES
        if not rows:
            continue
        sent = sc.broadcast((np.array([r.vec_id for r in rows], np.int64), _pad([bytes(r.v) for r in rows], most // 8), most // 8))
        found = ints.mapInArrow(_search(sent, k), "query_id long, vec_id long, score long")
        found = found.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k)
        space.save(found.select("query_id", "rank", "vec_id", "score"), f"found/block={block}")
        sent.destroy()
    return ints.sparkSession.read.schema(empty.schema).parquet(f"{space.base}/found").select(empty.columns)
