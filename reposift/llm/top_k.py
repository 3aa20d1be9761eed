"""Exact top-k search by inner product with a KD-tree per shard."""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from reposift.llm.common import cut, ready

K = 5
SHARD = 8192  # vectors of a shard, about
BLOCK = 2048  # queries that a shard answers in one task, about
LEAF = 256

_EXACT = float(1 << 53)


class KdTree:
    """Median splits of the widest dimension, with the tight bounding box of every node."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        order = np.argsort(ids, kind="stable")
        self.ids, self.vectors = ids[order], vectors[order]
        self.low, self.high, self.children, self.rows = [], [], [], []
        self._build(np.arange(len(ids)))
        self.low, self.high = np.array(self.low), np.array(self.high)

    def _build(self, rows: np.ndarray) -> int:
        part = self.vectors[rows]
        low, high = part.min(axis=0), part.max(axis=0)
        node = len(self.rows)
        self.low.append(low), self.high.append(high), self.children.append(None), self.rows.append(None)
        if len(rows) <= LEAF or not len(low) or not (high > low).any():
            self.rows[node] = np.sort(rows)
            return node
        order = np.argsort(part[:, (high - low).argmax()], kind="stable")
        half = len(rows) // 2
        self.children[node] = self._build(rows[order[:half]]), self._build(rows[order[half:]])
        return node

    def bounds(self, queries: np.ndarray) -> np.ndarray:
        """Highest inner product that a point of each node's box can have, per query."""
        return np.maximum(queries, 0) @ self.high.T + np.minimum(queries, 0) @ self.low.T

    def own(self, query_id: int, query: np.ndarray) -> int:
        """A row with the id and the vector of the query, -1 if there is none."""
        start, end = np.searchsorted(self.ids, [query_id, query_id + 1])
        equal = np.flatnonzero((self.vectors[start:end] == query).all(axis=1))
        return start + equal[0] if len(equal) else -1

    def search(self, own: int, query: np.ndarray, bounds: np.ndarray, k: int, kth) -> list[tuple]:
        """The best (score, -id) of the tree that reach ``kth``, from other rows than ``own``."""
        best: list[tuple] = []
        nodes = [(-bounds[0], 0)]
        while nodes:
            bound, node = heapq.heappop(nodes)
            if kth is not None and -bound < kth:
                break
            if self.children[node] is not None:
                for child in self.children[node]:
                    heapq.heappush(nodes, (-bounds[child], child))
                continue
            rows = self.rows[node]
            scores = self.vectors[rows] @ query
            if kth is not None:
                near = scores >= kth
                rows, scores = rows[near], scores[near]
            if len(rows) > k + 1:
                # The k best of a leaf and all that tie with the last, besides the query itself.
                near = scores >= np.partition(scores, len(rows) - k - 1)[len(rows) - k - 1]
                rows, scores = rows[near], scores[near]
            for row, score in zip(rows, scores):
                if row != own:
                    entry = (int(score), -int(self.ids[row]))
                    if len(best) < k:
                        heapq.heappush(best, entry)
                    elif entry > best[0]:
                        heapq.heapreplace(best, entry)
            if len(best) == k:
                kth = best[0][0] if kth is None else max(kth, best[0][0])
        return best


def _matrix(rows: pd.Series) -> np.ndarray:
    return np.stack([np.asarray(x, dtype=np.float64) for x in rows])


def _exact(*matrices: np.ndarray) -> list[np.ndarray]:
    """As doubles if all sums of products are exact in them, else as integers of any size."""
    most = np.prod([max(1.0, float(np.abs(m).max(initial=0))) for m in matrices]) * max(1, matrices[0].shape[1])
    if most < _EXACT:
        return list(matrices)
    return [np.array([[int(x) for x in row] for row in m], dtype=object).reshape(m.shape) for m in matrices]


def _answers(k: int):
    def run(points: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        found = []
        if len(points) and len(queries):
            vectors, asked = _exact(_matrix(points["x"]), _matrix(queries["x"]))
            tree = KdTree(points["vec_id"].to_numpy(), vectors)
            bounds = tree.bounds(asked)
            for i, (query, query_id, kth) in enumerate(zip(queries["query"], queries["query_id"], queries["kth"])):
                kth, own = None if pd.isna(kth) else int(kth), tree.own(query_id, asked[i])
                for score, vec_id in tree.search(own, asked[i], bounds[i], k, kth):
                    found.append((query, query_id, -vec_id, score))
        return pd.DataFrame(found, columns=["query", "query_id", "vec_id", "score"]).astype("int64")

    return run


def _search(points: DataFrame, queries: DataFrame, keys: list[str], k: int) -> DataFrame:
    return (
        points.groupBy(*keys)
        .cogroup(queries.groupBy(*keys))
        .applyInPandas(_answers(k), "query long, query_id long, vec_id long, score long")
    )


def _best(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def integer_vectors(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``vec_id, x``: floor(256 * component) of the vectors that take part."""
    vector = F.col(vector_col)
    bad = F.exists(vector, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    return df.filter(vector.isNotNull() & ~F.coalesce(bad, F.lit(False)) & F.col(id_col).isNotNull()).select(
        F.col(id_col).cast("long").alias("vec_id"),
        F.transform(vector, lambda v: F.floor(F.lit(256.0) * v.cast("double")).cast("double")).alias("x"),
    )


def exact_top_k(vectors: DataFrame, queries: DataFrame, k: int = K) -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``k`` highest inner products for each query.

    Both tables are ``vec_id, x`` as :func:`integer_vectors` gives them. Candidates are all
    vectors of the query's length but the query's own row, which is one with its id and vector;
    ties go to the smaller id, fewer candidates give fewer rows. Rows that repeat an id, or id and
    vector, are a query and a candidate each.

    Vectors are dealt to shards of about :data:`SHARD`, queries to blocks. Each query first
    searches one shard, best boxes first; its k-th score then goes with it to all other shards,
    which skip every box that cannot reach it.
    """
    ready(vectors.sparkSession)
    rows = vectors.count()
    shards = max(1, -(-rows // SHARD))
    size = F.size("x")
    points = cut(
        vectors.withColumns(
            {
                "length": size,
                "shard": F.pmod(F.xxhash64("vec_id", "x"), F.lit(shards)).cast("int"),
            }
        ),
        "points",
    )
    asked = queries.select(F.monotonically_increasing_id().alias("query"), F.col("vec_id").alias("query_id"), "x")
    blocks = max(1, -(-queries.count() // BLOCK))
    asked = cut(
        asked.withColumns(
            {
                "length": size,
                "block": F.pmod(F.xxhash64("query"), F.lit(blocks)).cast("int"),
                "home": F.pmod(F.hash("query"), F.lit(shards)).cast("int"),
            }
        ),
        "queries",
    )
    keys = ["shard", "block", "length"]
    dealt = points.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    first = asked.select("query", "query_id", "x", "length", "block", F.col("home").alias("shard"), F.lit(None).cast("long").alias("kth"))
    found = cut(_search(dealt, first, keys, k), "home")
    kth = found.groupBy("query").agg(
        F.when(F.count(F.lit(1)) == k, F.min("score")).alias("kth")
    )
    others = (
        asked.join(kth, "query", "left")
        .withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))
        .filter("shard <> home")
        .select("query", "query_id", "x", "length", "block", "shard", "kth")
    )
    found = found.unionByName(_search(dealt, others, keys, k)) if shards > 1 else found
    return _best(found, k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
