"""Exact top-k inner products by the threshold algorithm (Fagin) over sorted lists of each dimension.

Candidates lie in blocks; a block has, for every dimension, its members sorted by that component. A query
reads each list from the end that raises its score (the top for positive weights, the bottom for negative)
to a growing depth, scores every newly seen member in full, and stops once its kth score is above the bound:
the score of an imagined member with the components at the current depth. Equal scores don't stop it, since
the smaller id wins ties. A block's winners are merged over blocks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

SCALE = 256
CANDIDATES = 32_768  # vectors of a candidate block, about
QUERIES = 8192  # vectors of a query block, about
MOST = float(1 << 62)  # bound of a squared norm, so that no sum of products leaves 64 bits
FIRST_DEPTH = 16


def quantised(vectors: DataFrame, scale: int = SCALE) -> DataFrame:
    """vec_id and v, the components floor(scale * x) as long; without null, empty or non-finite vectors and ids.

    Scores are exact 64-bit sums. Where scaled components are so large that a sum of products could leave 64 bits,
    :func:`top_k` raises an OverflowError before it searches; nothing is rounded or wraps.
    """
    x = F.transform(vectors["embedding"], lambda c: c.cast("double"))
    own = vectors.select(vectors["vec_id"].cast("bigint").alias("vec_id"), x.alias("x"))
    bad = lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf"))
    own = own.where(F.col("vec_id").isNotNull() & F.col("x").isNotNull() & (F.size("x") > 0) & ~F.coalesce(F.exists("x", bad), F.lit(False)))
    norm = F.aggregate("x", F.lit(0.0), lambda a, c: a + F.floor(c * float(scale)).cast("double") * F.floor(c * float(scale)).cast("double"))
    return own.select("vec_id", F.transform("x", lambda c: F.floor(c * float(scale))).alias("v"), norm.alias("norm"))


class Lists:
    """Sorted lists of a block: order[d] has the members by falling component d."""

    def __init__(self, ids: np.ndarray, v: np.ndarray):
        self.ids, self.v = ids, v
        self.order = np.argsort(-v, axis=0, kind="stable").T.copy()
        self.sorted = np.take_along_axis(v, self.order.T, 0).T.copy()

    def search(self, query: np.ndarray, k: int, own_id: int) -> tuple[np.ndarray, np.ndarray, int]:
        """Ids and scores of the best k (own_id left out), best first, and how many members were scored."""
        n = len(self.ids)
        seen = np.zeros(n, bool)
        best_ids, best = np.zeros(0, np.int64), np.zeros(0, np.int64)
        used = np.flatnonzero(query)
        up, down = used[query[used] > 0], used[query[used] < 0]
        depth, scored = 0, 0
        while depth < n:
            last, depth = depth, min(n, max(FIRST_DEPTH, 2 * depth))
            new = np.zeros(n, bool)
            if len(used):
                new[self.order[up, last:depth]] = True
                new[self.order[down, n - depth : n - last]] = True
            else:
                new[:] = True
            new &= ~seen
            seen |= new
            at = np.flatnonzero(new)
            scored += len(at)
            own = self.v[at] @ query
            keep = self.ids[at] != own_id
            ids, scores = np.concatenate([best_ids, self.ids[at][keep]]), np.concatenate([best, own[keep]])
            if len(scores) > 4 * k + 64:
                floor = np.partition(scores, len(scores) - k)[len(scores) - k]
                ids, scores = ids[scores >= floor], scores[scores >= floor]
            order = np.lexsort((ids, -scores))[:k]
            best_ids, best = ids[order], scores[order]
            bound = int(query[up] @ self.sorted[up, depth - 1] + query[down] @ self.sorted[down, n - depth])
            if len(best) == k and best[-1] > bound or not len(used):
                break
        return best_ids, best, scored


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 5, candidates: int = CANDIDATES, per_block: int = QUERIES) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: each query's k best other vectors, ties to the smaller vec_id.

    Both frames are (vec_id, v, norm) as of :func:`quantised`. Every row counts: rows that repeat a vec_id are
    candidates each (but for a query of that vec_id), and their results as queries are ranked together. Vectors of
    another length than the query's take no part for it. A block of queries meets a block of candidates in one
    task; both are of bounded size, whatever the tables hold, and only tasks' winners are merged.
    """
    size = lambda df: df.agg(F.count("*").alias("n"), F.max("norm").alias("norm")).first()
    (n, large), (m, asked_large) = size(vectors), size(queries)
    if n and m and (large * asked_large) ** 0.5 >= MOST:  # by Cauchy and Schwarz, of every part of a sum too
        raise OverflowError(f"inner products of vectors with squared norms up to {max(large, asked_large):.3g} may leave 64 bits")
    vectors, queries = vectors.select("vec_id", "v"), queries.select("vec_id", "v")
    blocks, sets = max(1, -(-n // candidates)), max(1, -(-m // per_block))
    place = lambda n, seed: F.pmod(F.xxhash64("vec_id", F.lit(seed)), F.lit(n)).cast("int")
    left = vectors.select(place(blocks, 1).alias("b"), F.explode(F.sequence(F.lit(0), F.lit(sets - 1))).alias("s"), "vec_id", "v")
    right = queries.select(place(sets, 2).alias("s"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("b"), F.col("vec_id").alias("q_id"), F.col("v").alias("q"))

    def search(members: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        out = []
        for size, own in members.groupby(members["v"].map(len)):
            own = own.sort_values("vec_id")
            lists = Lists(own["vec_id"].to_numpy(np.int64), np.stack(own["v"].to_numpy()).astype(np.int64))
            for q, v in zip(asked["q_id"], asked["q"]):
                if len(v) == size:
                    ids, scores, scored = lists.search(np.asarray(v, np.int64), k, q)
                    out += [(q, i, s, scored) for i, s in zip(ids, scores)]
        return pd.DataFrame(out, columns=["query_id", "vec_id", "score", "scored"])

    found = left.groupBy("b", "s").cogroup(right.groupBy("b", "s")).applyInPandas(search, "query_id bigint, vec_id bigint, score bigint, scored bigint")
    best = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.select("query_id", F.row_number().over(best).alias("rank"), "vec_id", "score").where(F.col("rank") <= k)
