"""Exact top-k search by no-random-access aggregation.

The score of a candidate is the sum of one product per dimension. Candidates are dealt
into blocks of bounded size; a block keeps, for each dimension, the list of its candidates
sorted by value. For a query every list is read from its best end, a stretch at a time.
What has been read bounds a candidate's score from below (products read, plus the least
that each unread list can add) and from above (products read, plus the value at which each
unread list now stands). Reading stops once few candidates have an upper bound that
reaches the k-th lower bound: nobody else, read or not, can enter the first k. The final
scores of those few are then resolved exactly.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import saved, scratch, table

BLOCK = 8192  #: candidates in a block, about
QUERIES = 4096  #: queries that meet a block in one task, about


class Lists:
    """The sorted lists of one block."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray) -> None:
        by_id = np.argsort(ids, kind="stable")
        self.ids, self.exact = ids[by_id], vectors[by_id]
        self.values = self.exact.astype(np.float64)
        self.order = np.argsort(self.values, axis=0, kind="stable").T.copy()  # dimension x depth, ascending
        self.sorted = np.take_along_axis(self.values.T, self.order, axis=1)

    def top(self, query_id: int, query: np.ndarray, k: int, most_left: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and exact scores of the k best other than query_id; ties to smaller ids."""
        n, d = self.values.shape
        q = query.astype(np.float64)
        own = np.flatnonzero(self.ids == query_id)
        want = min(k + len(own), n)
        up = q > 0
        ends = np.where(up, self.sorted[:, 0], self.sorted[:, -1]) if d else np.zeros(0)
        least = q * ends  # the least that a list can add
        extra = np.zeros(n)  # of each candidate: what its read products exceed the least by
        unread_gap = np.zeros((n, d), np.float32)  # 1 where a candidate has been read
        depth, step = 0, max(64, n // 16)
        inside = np.arange(n)
        while depth < n and d:
            to = min(n, depth + step)
            rows = np.where(up[:, None], self.order[:, n - to : n - depth], self.order[:, depth:to])
            vals = np.where(up[:, None], self.sorted[:, n - to : n - depth], self.sorted[:, depth:to])
            add = q[:, None] * vals - least[:, None]
            extra += np.bincount(rows.ravel(), add.ravel(), n)
            unread_gap[rows, np.arange(d)[:, None]] = 1
            depth = to
            if depth == n:
                front = np.zeros(d)
            else:
                front = q * np.where(up, self.sorted[:, n - depth - 1], self.sorted[:, depth]) - least
            above = extra + front.sum() - unread_gap @ front.astype(np.float32) * 1.0
            slack = 1e-3 * (1 + np.abs(front).sum())  # the bound's rounding, on the safe side
            floor = np.partition(extra, n - want)[n - want]
            inside = np.flatnonzero(above + slack >= floor)
            if len(inside) <= most_left:
                break
        inside = inside[self.ids[inside] != query_id]
        scores = self.exact[inside] @ query
        best = np.lexsort((self.ids[inside], -scores))[:k]
        return self.ids[inside[best]], scores[best]


def top_k(queries: DataFrame, candidates: DataFrame, k: int = 10, block: int = BLOCK, batch: int = QUERIES) -> DataFrame:
    """queries, candidates: vec_id, vector (array of long). Returns query_id, rank, vec_id, score.

    A candidate with the query's own id takes no part, nor do null ids and null vectors;
    vectors meet vectors of their own length. Rows that repeat an id are candidates of their
    own; queries that repeat one are searched each and share the k places of their id. Ties go
    to the smaller id. Fewer than k candidates: all of them.
    Empty tables give an empty result. Components so large that a score might not fit a long
    are an error; scores are exact up to there.

    Every query must meet every block, so the queries are sent to each block and the
    candidates once to each batch of queries: both kinds of group are bounded.
    """
    with scratch():
        usable = lambda df: df.select("vec_id", "vector").dropna().withColumn("row", F.monotonically_increasing_id())
        queries, candidates = saved(usable(queries), "queries"), saved(usable(candidates), "candidates")
        largest = F.greatest(*[F.abs(f("vector").cast("double")) for f in (F.array_max, F.array_min)])
        told = [F.count(F.lit(1)), F.coalesce(F.max(largest), F.lit(0.0)), F.coalesce(F.max(F.size("vector")), F.lit(0))]
        (n_queries, most_query, dims), (n_candidates, most_candidate, _) = queries.agg(*told).first(), candidates.agg(*told).first()
        if most_query * most_candidate * dims >= 2.0**62:
            raise ValueError("components are too large: a score might not fit a long")
        n_blocks = max(1, -(-n_candidates // block))
        n_batches = max(1, -(-n_queries // batch))
        deal = lambda n, seed: F.pmod(F.xxhash64("row", F.lit(seed)), F.lit(n)).cast("int")
        every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
        dim = F.size("vector").alias("dim")
        left = candidates.select("vec_id", "vector", dim, deal(n_blocks, 1).alias("block"), every(n_batches).alias("batch"))
        right = queries.select("vec_id", "vector", dim, deal(n_batches, 2).alias("batch"), every(n_blocks).alias("block"))

        def search(c: pd.DataFrame, q: pd.DataFrame) -> pd.DataFrame:
            if not len(c) or not len(q):
                return pd.DataFrame({"query_id": [], "vec_id": [], "score": []}, dtype="int64")
            lists = Lists(c["vec_id"].to_numpy(), np.array(c["vector"].tolist(), np.int64).reshape(len(c), -1))
            found = [(i, *lists.top(i, np.asarray(v, np.int64), k, 8 * k)) for i, v in zip(q["vec_id"], q["vector"], strict=True)]
            return pd.DataFrame({"query_id": np.repeat([f[0] for f in found], [len(f[1]) for f in found]).astype(np.int64), "vec_id": np.concatenate([f[1] for f in found]), "score": np.concatenate([f[2] for f in found])})

        keys = ["dim", "block", "batch"]
        found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(search, "query_id long, vec_id long, score long")
        best = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
        return saved(found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score"), "best", keep=True)


def whole_vectors(rows: DataFrame) -> DataFrame:
    """vec_id, embedding to vec_id, vector of floor(1024 * x).

    Vectors that are null or hold null, NaN or infinite components take no part. A component
    beyond the range of a long becomes its end, which top_k refuses.
    """
    good = F.coalesce(F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))), F.lit(False))
    return rows.filter(good).select("vec_id", F.transform("embedding", lambda x: F.floor(x.cast("double") * 1024)).alias("vector"))


def op1_top_k_search(spark, sf_dir):
    vectors = whole_vectors(table(spark, sf_dir, "embeddings"))
    return top_k(vectors.filter("vec_id % 100 = 0"), vectors, 10)


OP1_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(x::DOUBLE * 1024)) AS vector FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_sum(list_transform(list_zip(q.vector, c.vector), lambda p: p[1] * p[2]))::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0
)
SELECT query_id, rank::INT AS rank, vec_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s
) WHERE rank <= 10
"""
