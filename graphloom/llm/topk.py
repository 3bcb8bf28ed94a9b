"""Exact top-k search by inner product without random access.

In each block of vectors, every dimension is a list sorted by its component. Lists are read in step, from the end where
a query's products are highest; a vector's score is bounded below and above by what was read and, for what was not, by
the last value read and by the list's other end. Reading stops for a query once few vectors are left whose upper bound
reaches the k-th lower bound, or the k-th score that a first small block has given; their scores are then resolved.
Blocks' best are merged.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import require, table, written

K, QUERY_STEP = 5, 50
#: Vectors of a block and queries of a batch: what one task holds at once. Vectors of the first block.
BLOCK, BATCH, SEED = 4096, 4096, 512
#: Queries whose bounds are held at once.
TOGETHER = 256
#: Parts of the lists after which bounds are compared: doubling up to half, then in steps.
STEPS = (1 / 8, 1 / 4, *(s / 16 for s in range(8, 17)))
#: Candidates left for one query at which reading stops.
RESOLVE = 48


def no_random_access(q: np.ndarray, x: np.ndarray, own: np.ndarray, ids: np.ndarray, k: int = K, floor: np.ndarray | None = None) -> Iterator[tuple[int, list[tuple[int, object]], float]]:
    """For each row of ``q``: its place, (vector row, score) of the ``k`` best of ``x``, and the part of each list read.

    ``own``: the queries' ids, which are no candidates of theirs. Vectors below ``floor`` (a score for each query) may
    be left out. Ties go to the smaller id. Sums are exact: in float64 while they stay below 2**53, else in Python
    integers.
    """
    n, d = x.shape
    if not n or not len(q):
        return
    exact = float(np.abs(q).max(initial=0)) * float(np.abs(x).max(initial=0)) * max(d, 1) < 1 << 53
    q, x = (q.astype(float), x.astype(float)) if exact else (q.astype(object), x.astype(object))
    order = np.argsort(-x, axis=0, kind="stable")
    rank = np.empty((n, d), dtype=np.int64)
    np.put_along_axis(rank, order, np.arange(n)[:, None], axis=0)
    lists = np.take_along_axis(x, order, axis=0)
    # Positive components read their lists from the top, negative ones from the end.
    both = np.concatenate([np.where(q > 0, q, 0), np.where(q < 0, q, 0)], axis=1)
    floor = np.full(len(q), -np.inf) if floor is None else floor
    waiting = np.arange(len(q))
    for depth in sorted({min(n, max(k, ceil(n * s))) for s in STEPS}):
        if not len(waiting):
            return
        seen_top, seen_end = rank < depth, rank >= n - depth
        most = np.concatenate([np.where(seen_top, x, lists[depth - 1]), np.where(seen_end, x, lists[n - depth])], axis=1).T
        least = np.concatenate([np.where(seen_top, x, lists[-1]), np.where(seen_end, x, lists[0])], axis=1).T
        upper, lower = (both[waiting] @ most).astype(float), (both[waiting] @ least).astype(float)
        mine = own[waiting][:, None] == ids[None, :]
        upper[mine], lower[mine] = -np.inf, -np.inf
        reach = np.maximum(np.partition(lower, n - k, axis=1)[:, n - k] if n >= k else -np.inf, floor[waiting])
        # Bounds are compared with room for the rounding of large integers.
        reach = np.where(np.isfinite(reach), reach - np.abs(np.where(np.isfinite(reach), reach, 0)) * 1e-12, -np.inf)
        hopeful = (upper >= reach[:, None]) & ~mine
        stop = (hopeful.sum(axis=1) <= max(RESOLVE, 4 * k)) | (depth == n)
        for i in np.flatnonzero(stop):
            rows = np.flatnonzero(hopeful[i])
            scores = x[rows] @ q[waiting[i]] if d else np.zeros(len(rows))
            best = sorted(range(len(rows)), key=lambda j: (-scores[j], ids[rows[j]]))[:k]
            yield int(waiting[i]), [(int(rows[j]), scores[j]) for j in best], depth / n
        waiting = waiting[~stop]


def integers(vectors: DataFrame) -> DataFrame:
    """vec_id, v: floor(256 * x) of each component. Rows without vec_id, vector, or finite components are left out."""
    require(vectors, "vec_id", "embedding")
    whole = F.forall("embedding", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf")))
    return vectors.where("vec_id IS NOT NULL AND embedding IS NOT NULL").where(whole).select(F.col("vec_id").cast("long").alias("vec_id"), F.transform("embedding", lambda c: F.floor(c.cast("double") * 256).cast("long")).alias("v"))


def search(vectors: DataFrame, k: int = K, step: int = QUERY_STEP, with_depth: bool = False) -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` best rows for each row whose vec_id is divisible by ``step``.

    Score: integer inner product with vectors of the same length. Every row but those with the query's own vec_id is a
    candidate; fewer than ``k`` are all returned. Ties go to the smaller vec_id. Rows that repeat a vec_id are
    candidates each, and one query if their vectors agree. An empty table gives an empty result; a score outside 64
    bits fails the query. ``with_depth`` adds ``depth``, the part of each list that was read in the row's block.

    Queries (a stated set) meet all rows in blocks: tasks hold one block of vectors and one batch of queries. The k-th
    score in a first block of about SEED vectors is what others have to reach.
    """
    v = written(integers(vectors), "topk-vectors")
    queries = v.where(F.col("vec_id") % step == 0).dropDuplicates(["vec_id", "v"]).select(F.col("vec_id").alias("query_id"), F.col("v").alias("q"))
    queries = queries.withColumn("copy", F.xxhash64("q"))
    n = v.count()
    blocks, batches = max(1, -(-n // BLOCK)), max(1, -(-queries.count() // BATCH))

    def dealt(df: DataFrame, key: str, n: int, other: str, m: int) -> DataFrame:
        # By a number of the row, so that rows that repeat an id or a vector are dealt too; what is found is the same.
        return df.withColumn(key, F.pmod(F.xxhash64(df.columns[0], F.monotonically_increasing_id()), F.lit(n)).cast("int")).withColumn(other, F.explode(F.sequence(F.lit(0), F.lit(m - 1))))

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(left) and len(right):
            lengths = left["v"].map(len)
            for d in sorted(set(right["q"].map(len))):
                a, b = right[right["q"].map(len) == d], left[lengths == d]
                if not len(b):
                    continue
                x, ids = np.array(list(b["v"]), dtype=np.int64).reshape(len(b), d), b["vec_id"].to_numpy()
                for at in range(0, len(a), TOGETHER):
                    some = a.iloc[at : at + TOGETHER]
                    q, own, copy = np.array(list(some["q"]), dtype=np.int64).reshape(len(some), d), some["query_id"].to_numpy(), some["copy"].to_numpy()
                    floor = some["floor"].to_numpy(dtype=float, na_value=-np.inf)
                    out += [(own[i], copy[i], ids[j], int(s), depth) for i, best, depth in no_random_access(q, x, own, ids, k, floor) for j, s in best]
        return pd.DataFrame(out, columns=["query_id", "copy", "vec_id", "score", "depth"]).astype({"query_id": "int64", "copy": "int64", "vec_id": "int64", "score": "int64", "depth": "float64"})

    def found(rows: DataFrame, asked: DataFrame, blocks: int) -> DataFrame:
        left = dealt(rows, "block", blocks, "batch", batches).groupBy("block", "batch")
        right = dealt(asked, "batch", batches, "block", blocks).groupBy("block", "batch")
        best = left.cogroup(right).applyInPandas(run, "query_id long, copy long, vec_id long, score long, depth double")
        place = F.row_number().over(Window.partitionBy("query_id", "copy").orderBy(F.desc("score"), "vec_id"))
        return best.withColumn("rank", place.cast("int")).where(F.col("rank") <= k)

    # A score above 2**53 is rounded down as a floor, and its room with it.
    first = v.where(F.pmod(F.xxhash64("vec_id", F.lit(2)), F.lit(max(1, n // SEED))) == 0)
    floors = found(first, queries.withColumn("floor", F.lit(None).cast("double")), 1).where(F.col("rank") == k)
    floors = written(floors.select("query_id", "copy", (F.col("score").cast("double") - F.abs("score") * 1e-12).alias("floor")), "topk-floors")
    best = found(v, queries.join(floors, ["query_id", "copy"], "left").select("query_id", "q", "copy", "floor"), blocks)
    return best.select("query_id", "rank", "vec_id", "score", *["depth"] * with_depth)


def op2_exact_topk(spark, sf_dir):
    return search(table(spark, sf_dir, "embeddings"))


QUERIES = {"op2_exact_topk": op2_exact_topk}
ORACLES = {
    "op2_exact_topk": """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS DOUBLE)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, v.vec_id, CAST(list_inner_product(q.v, v.v) AS BIGINT) AS score
  FROM v q JOIN v ON q.vec_id <> v.vec_id AND len(q.v) = len(v.v) WHERE q.vec_id % 50 = 0)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 5
"""
}
