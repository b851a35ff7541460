"""Exact top-k by inner product: columnar branch and bound.

Candidates lie in shards in vertical layout: one row of an array for each
dimension.  For a query, the inner products are accumulated over blocks of
dimensions.  After a block, what the remaining dimensions can still add is at
most the product of the two remainders' lengths (their mass); candidates that
cannot reach the query's k-th best score so far are dropped, and the survivors
are compacted for the next block.  Ties stay in, so the result is exact.

Queries and candidates are dealt into a grid: every query block meets every
candidate shard once, in a task of its own, and leaves its k best there; these
are then merged.  Blocks and shards have a bounded size, whatever the table's.

Components are whole numbers floor(scale * x), and scores are exact integers
(below 2 ** 53).

Defined results: vectors that are null or hold a null or non-finite component,
and rows with a null id, take no part; a vector of another width than the
first query's meets only those of its own width; equal scores go to the
smaller id; the same id twice counts as two candidates for others, but no row
of a query's own id is its candidate; with fewer than k candidates all are
given.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows of one query block and of one candidate shard, about.
QUERY_ROWS, SHARD_ROWS = 2048, 8192
#: Dimensions of a block.
BLOCK_DIMS = 16


def best(queries: np.ndarray, query_ids: np.ndarray, shard: np.ndarray, ids: np.ndarray, k: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each query the ids and scores of its k best in the shard, best first.

    ``shard`` is (dimensions, candidates), with the candidates in order of id.
    """
    dims = len(shard)
    cuts = [*range(0, max(dims, 1), BLOCK_DIMS), dims]
    blocks = [shard[a:b].astype(np.float64) for a, b in zip(cuts, cuts[1:], strict=False)]
    whole = queries.astype(np.float64)
    # lengths of what is left of each vector behind a block
    left = [np.sqrt((shard[b:].astype(np.float64) ** 2).sum(axis=0)) for b in cuts[1:]]
    query_left = [np.sqrt((whole[:, b:] ** 2).sum(axis=1)) for b in cuts[1:]]
    for i, own in enumerate(query_ids):
        q = whole[i]
        keep = np.arange(shard.shape[1])
        score = q[: cuts[1]] @ blocks[0]
        # the first bound: exact scores of the candidates that lead after the first block
        bound = -np.inf
        if len(keep) > 4 * k:
            lead = np.argpartition(-score, 3 * k)[: 3 * k]
            exact = q @ shard[:, lead]
            exact = exact[ids[lead] != own]
            if len(exact) >= k:
                bound = np.partition(exact, len(exact) - k)[len(exact) - k]
        for b in range(len(blocks)):
            if b:
                score = score + q[cuts[b] : cuts[b + 1]] @ blocks[b][:, keep]
            # a unit of slack: the bound is a float, the scores are whole numbers
            live = score + query_left[b][i] * left[b][keep] >= bound - 1
            keep, score = keep[live], score[live]
        other = ids[keep] != own
        keep, score = keep[other], score[other]
        order = np.lexsort((ids[keep], -score))[:k]
        yield ids[keep[order]], score[order].astype(np.int64)


def whole_vectors(df: DataFrame, key: str, vector: str, scale: int) -> DataFrame:
    """(id, v): the vectors as whole numbers; those that take no part are left out."""
    v = F.col(vector)
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    rows = df.where(F.col(key).isNotNull() & v.isNotNull() & finite)
    return rows.select(F.col(key).cast("long").alias("id"), F.transform(v, lambda x: F.floor(x.cast("double") * scale).cast("long")).alias("v"))


def top_k(df: DataFrame, is_query: Column, key: str = "vec_id", vector: str = "embedding", scale: int = 256, k: int = 5) -> DataFrame:
    """(query_id, rank, key, score): the k best other rows of every query row."""
    rows = whole_vectors(df, key, vector, scale)
    # equal rows of an id are one query; rows of other vectors are queries of their own
    queries = rows.where(is_query).distinct().withColumn("ask", F.xxhash64("v"))
    n, m = rows.count(), queries.count()
    shards, blocks = max(1, -(-n // SHARD_ROWS)), max(1, -(-m // QUERY_ROWS))
    mine = F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int")
    part = F.pmod(F.xxhash64("id", "v"), F.lit(shards)).cast("int")
    # every query block is sent to every shard, every shard to every query block
    left = queries.select(mine.alias("block"), F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"), "id", "ask", "v")
    right = rows.select(F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), part.alias("shard"), "id", "v")

    def run(ours: pa.Table, theirs: pa.Table) -> pa.Table:
        out: list[tuple] = []
        a, b = _by_width(ours), _by_width(theirs)
        asks = ours.column("ask").to_numpy()
        for width, (pick, query_ids, vectors) in a.items():
            if width in b:
                _, ids, candidates = b[width]
                if _longest(vectors) * _longest(candidates) >= 2.0**53:
                    raise ValueError("components are too large for exact scores")
                order = np.argsort(ids, kind="stable")
                shard = np.ascontiguousarray(candidates[order].T)
                for q, ask, (found, score) in zip(query_ids, asks[pick], best(vectors, query_ids, shard, ids[order], k), strict=True):
                    out += zip([q] * len(found), [ask] * len(found), found, score, strict=True)
        cols = list(zip(*out, strict=True)) or [(), (), (), ()]
        return pa.table({c: pa.array(x, pa.int64()) for c, x in zip(("query_id", "ask", "id", "score"), cols, strict=True)})

    near = left.groupBy("block", "shard").cogroup(right.groupBy("block", "shard")).applyInArrow(run, "query_id long, ask long, id long, score long")
    # k of each shard at most; the window keeps k rows of each query before the shuffle, too
    order = Window.partitionBy("query_id", "ask").orderBy(F.col("score").desc(), "id")
    ranked = near.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", F.col("id").alias(key), "score")


def _longest(vectors: np.ndarray) -> float:
    """The greatest length of a vector: no inner product is above that of two lengths."""
    return float(np.sqrt((vectors.astype(np.float64) ** 2).sum(axis=1).max(initial=0)))


def _by_width(rows: pa.Table) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """By the number of components: places of the rows, ids, vectors."""
    ids = rows.column("id").to_numpy()
    lists = rows.column("v").combine_chunks()
    if isinstance(lists, pa.ChunkedArray):
        lists = lists.chunk(0) if lists.num_chunks else pa.array([], pa.list_(pa.int64()))
    widths = np.diff(lists.offsets.to_numpy())
    flat = lists.flatten().to_numpy()
    at = np.cumsum(widths) - widths
    out = {}
    for w in np.unique(widths).tolist():
        pick = np.flatnonzero(widths == w)
        out[w] = (pick, ids[pick], flat[at[pick][:, None] + np.arange(w)].reshape(len(pick), w))
    return out
