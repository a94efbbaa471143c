"""Exact top-k by inner product with block-at-a-time pruning."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from postvet.llm.common import ready
from postvet.session import stored

SHELF_ROWS = 8192    # rows of a shelf, the unit that is dealt
BLOCK_ROWS = 256     # rows of a block, the unit that is pruned
QUERY_ROWS = 4096    # queries that are searched at once
PART_ROWS = 65536    # queries that meet a shelf in a task
FIRST_ROWS, FIRST_PARTS = 512, 64  # the same for the first shelf, and its most tasks


def quantised(vector: Column | str, scale: int = 256) -> Column:
    """floor(scale * x) of each component as double; null if one is null or scale * x not finite."""
    scaled = F.transform(vector, lambda x: x.cast("double") * scale)
    bad = F.exists(scaled, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    # From 2^53 on a double is a whole number; floor() would cut it to a long.
    return F.when(~bad, F.transform(scaled, lambda x: F.when(F.abs(x) < 2.0 ** 53, F.floor(x).cast("double")).otherwise(x)))


def search_block(
    queries: np.ndarray, query_ids: np.ndarray, ids: np.ndarray, matrix: np.ndarray, k: int,
    floor: np.ndarray | None = None,
) -> tuple[np.ndarray, np.ndarray, int]:
    """Best k of one shelf per query: (ids, scores, pairs scored); missing ones score -inf.

    Rows are in id order and cut into blocks. The bound of a block is the sum over the
    terms of the query's weight times the block's maximum (minimum, if the weight is
    negative). Each query visits the blocks by falling bound and stops as soon as the
    bound is below its k-th score so far, or below `floor`, a k-th score that it has
    elsewhere: equal bounds are visited, for ties by id. Sums must stay below 2^53.
    """
    starts = np.arange(0, len(ids), BLOCK_ROWS)
    high = np.maximum.reduceat(matrix, starts, axis=0)
    low = np.minimum.reduceat(matrix, starts, axis=0)
    bounds = np.maximum(queries, 0) @ high.T + np.minimum(queries, 0) @ low.T
    order = np.argsort(-bounds, axis=1, kind="stable")
    best = np.full((len(queries), k), -np.inf)
    best_ids = np.full((len(queries), k), np.iinfo(np.int64).max)
    scored, live = 0, np.arange(len(queries))
    floor = np.full(len(queries), -np.inf) if floor is None else floor
    for turn in range(len(starts)):
        block = order[live, turn]
        live_bounds = bounds[live, block]
        keep = live_bounds >= np.maximum(best[live, k - 1], floor[live])
        live, block = live[keep], block[keep]
        if not len(live):
            break
        for b in np.unique(block):
            mine = live[block == b]
            s, e = starts[b], min(starts[b] + BLOCK_ROWS, len(ids))
            scores = queries[mine] @ matrix[s:e].T
            scored += scores.size
            scores[query_ids[mine, None] == ids[None, s:e]] = -np.inf
            # Most blocks hold nothing that is good enough for most queries.
            enters = (scores >= np.maximum(best[mine, k - 1], floor[mine])[:, None]).any(axis=1)
            mine, scores = mine[enters], scores[enters]
            every = np.concatenate([best[mine], scores], axis=1)
            names = np.concatenate([best_ids[mine], np.broadcast_to(ids[s:e], scores.shape)], axis=1)
            at = np.lexsort((names, -every), axis=1)[:, :k]
            best[mine] = np.take_along_axis(every, at, axis=1)
            best_ids[mine] = np.take_along_axis(names, at, axis=1)
    return best_ids, best, scored


def search_exact(
    queries: np.ndarray, query_ids: np.ndarray, ids: np.ndarray, matrix: np.ndarray, k: int,
) -> tuple[np.ndarray, np.ndarray]:
    """Best k of the rows per query in whole numbers of any size: (ids, scores), None where there are fewer.

    A score beyond a long becomes the nearest long before rows are ranked.
    """
    top = np.iinfo(np.int64)
    best_ids, best = np.full((len(queries), k), -1), np.full((len(queries), k), None, object)
    whole = [[int(x) for x in row] for row in matrix]
    for i, query in enumerate(queries):
        weights = [int(x) for x in query]
        found = sorted(
            (-min(max(sum(a * b for a, b in zip(weights, row)), top.min), top.max), d)
            for d, row in zip(ids.tolist(), whole) if d != query_ids[i]
        )[:k]
        for j, (score, d) in enumerate(found):
            best_ids[i, j], best[i, j] = d, -score
    return best_ids, best


def search_shelf(
    queries: np.ndarray, query_ids: np.ndarray, ids: np.ndarray, matrix: np.ndarray, k: int, floor: np.ndarray,
) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(query ids, ids, scores): each query's best k of a shelf, and of its large rows once more.

    Where queries and rows are so small that sums stay below 2^53, blocks are searched;
    what is larger is summed in whole numbers.
    """
    limit = math.isqrt((1 << 53) // max(1, queries.shape[1])) - 1
    small_q, small_r = (np.abs(x).max(axis=1, initial=0) < limit for x in (queries, matrix))
    if small_q.any() and small_r.any():
        found, scores, _ = search_block(
            queries[small_q], query_ids[small_q], ids[small_r], matrix[small_r], k, floor[small_q]
        )
        at = np.isfinite(scores)
        yield np.repeat(query_ids[small_q], k).reshape(-1, k)[at], found[at], scores[at].astype(np.int64)
    for q, r in ((small_q, ~small_r), (~small_q, np.ones(len(ids), bool))):
        if q.any() and r.any():
            found, scores = search_exact(queries[q], query_ids[q], ids[r], matrix[r], k)
            at = np.not_equal(scores, None)
            yield np.repeat(query_ids[q], k).reshape(-1, k)[at], found[at], scores[at].astype(np.int64)


def _unpacked(ids: pa.ChunkedArray, vectors: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids, lengths of the vectors, and the vectors as rows of float64 padded with zeros."""
    made = vectors.combine_chunks()
    made = made.chunk(0) if isinstance(made, pa.ChunkedArray) else made
    sizes = made.value_lengths().to_numpy(zero_copy_only=False)
    out = np.zeros((len(sizes), max(1, sizes.max(initial=0))))
    out[np.arange(out.shape[1]) < sizes[:, None]] = made.flatten().to_numpy(zero_copy_only=False)
    return ids.to_numpy().astype(np.int64), sizes, out


def _once(ids: np.ndarray, sizes: np.ndarray, matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(ids, matrix) in id order; rows that repeat an id and a vector are there once."""
    order = np.argsort(ids, kind="stable")
    same = np.flatnonzero(np.diff(ids[order]) == 0)
    drop, seen = [], set()
    for at in np.unique(np.concatenate([same, same + 1])):
        row = order[at]
        known = (ids[row], matrix[row, :sizes[row]].tobytes())
        if known in seen:
            drop.append(at)
        seen.add(known)
    order = np.delete(order, drop)
    return ids[order], matrix[order]


def top_k(
    vectors: DataFrame, queries: DataFrame, k: int, key: str = "vec_id", vector: str = "embedding", scale: int = 256,
) -> DataFrame:
    """(query_id, rank, key, score): the k best rows for each query by integer inner product.

    All rows are searched. They are dealt to shelves of some thousand rows by a hash (id ranges
    are the blocks within), queries to parts; each part meets each shelf once in a task that
    holds the two. A task returns at most k rows per query, of which a window picks the best
    k: by score, then smaller id.

    The first shelf is searched before the others; the k-th scores that it gives are where
    the others begin to prune.

    Vectors that are null or hold null or non-finite components (also after scaling) take
    no part. Sums are exact at any size; a score beyond a long counts as the nearest long. Shorter
    vectors count as padded with zeros; an empty one scores 0. A row is no candidate for
    its own id. Rows that repeat an id and a vector count once; if the vectors of a
    query's id differ, the smallest one (as an array) is the query. An empty table gives
    no rows. Other columns are not looked at.
    """
    ready(vectors.sparkSession)
    v = quantised(vector, scale).alias("v")
    rows = vectors.select(F.col(key).alias("id"), v).filter("v IS NOT NULL AND id IS NOT NULL")
    asked = queries.select(F.col(key).alias("id"), v).filter("v IS NOT NULL AND id IS NOT NULL")
    count = max(1, -(-vectors.count() // SHELF_ROWS))
    # By id and vector: rows of one id are dealt out too, and those that repeat both meet.
    shelved = rows.withColumn("shelf", F.pmod(F.xxhash64("id", "v", F.lit(5)), F.lit(count)).cast("int"))
    one_each = stored(asked.groupBy("id").agg(F.min("v").alias("v")))
    many = one_each.count()
    parts = max(1, -(-many // PART_ROWS))

    def search(shelf: pa.Table, some: pa.Table) -> pa.Table:
        found = []
        if shelf.num_rows and some.num_rows:
            ids, matrix = _once(*_unpacked(shelf["id"], shelf["v"]))
            q_ids, _, asked = _unpacked(some["id"], some["v"])
            floor = some["floor"].to_numpy()
            width = min(matrix.shape[1], asked.shape[1])
            for i in range(0, len(q_ids), QUERY_ROWS):
                these = slice(i, i + QUERY_ROWS)
                found += search_shelf(asked[these, :width], q_ids[these], ids, matrix[:, :width], k, floor[these])
        columns = [np.concatenate(x) for x in zip(*found)] or [np.empty(0, np.int64)] * 3
        return pa.table(dict(zip(("query_id", "id", "score"), columns)))

    def met(asked: DataFrame, first: int, last: int, parts: int) -> DataFrame:
        dealt = (
            asked.withColumn("part", F.pmod(F.xxhash64("id", F.lit(6)), F.lit(parts)).cast("int"))
            .withColumn("shelf", F.explode(F.sequence(F.lit(first), F.lit(last))))
        )
        there = (
            shelved.filter(F.col("shelf").between(first, last))
            .withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
        )
        return there.groupBy("shelf", "part").cogroup(dealt.groupBy("shelf", "part")).applyInArrow(
            search, "query_id long, id long, score long"
        )

    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")

    def ranked(found: DataFrame) -> DataFrame:
        return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)

    # One shelf alone: its queries are dealt finer, so that they are many tasks.
    finer = max(parts, min(FIRST_PARTS, -(-many // FIRST_ROWS)))
    found = met(one_each.withColumn("floor", F.lit(float("-inf"))), 0, 0, finer)
    if count > 1:
        found = stored(ranked(found)).drop("rank")
        # The k-th score of the first shelf; a double may not be above it.
        kth = F.when(F.count("*") >= k, F.min("score").cast("double") - F.abs(F.min("score").cast("double")) * 1e-12)
        floors = found.groupBy(F.col("query_id").alias("id")).agg(kth.alias("floor"))
        seeded = one_each.join(floors, "id", "left").fillna(float("-inf"), ["floor"])
        found = found.unionByName(met(seeded, 1, count - 1, parts))
    return (
        ranked(found)
        .select("query_id", "rank", F.col("id").alias(key), "score")
    )
