"""Exact top-k search by inner product over KD-trees, a tree for each shard.

Components become integers, floor(scale * x), so that scores are exact. The rows are dealt to shards
by a hash of their content; a shard's tree splits at the median of its widest dimension and keeps a
tight bounding box for every node. A query descends best-first: a heap of nodes ordered by the
largest inner product their box allows, which ends when no box can reach the kth score. A first
round on one shard per query gives its kth score to the searches in all other shards.

A shard meets all queries, in splits that bound a group; its root box is not asked beforehand.

Defined results: vectors that are null or hold a null or a component that is not finite take no
part; vectors of different lengths are not compared; the query's own id is no candidate, so rows
that repeat it aren't either; other equal rows are each candidates, ties go to the smaller id, null
ids last. A query row that is repeated gives its result once. Scores beyond a long are held at its
limits. Extra columns are ignored, empty tables give empty results.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialize, table

#: Rows of a shard, of a leaf, and of a block of queries.
SHARD, LEAF, QUERIES = 16384, 128, 256
LIMIT = 2**63 - 1


class KDTree:
    """Nodes as arrays; a leaf is a slice of the rows, which are kept in the tree's order."""

    def __init__(self, vectors: np.ndarray, ids: np.ndarray):
        order = np.arange(len(ids))
        self.low, self.high, self.span, self.children = [], [], [], []
        todo = [(0, len(ids), None, 0)]
        while todo:
            lo, hi, parent, side = todo.pop()
            rows = vectors[order[lo:hi]]
            a, b = rows.min(axis=0), rows.max(axis=0)
            node = len(self.span)
            self.low.append(a)
            self.high.append(b)
            self.span.append((lo, hi))
            self.children.append([-1, -1])
            if parent is not None:
                self.children[parent][side] = node
            if hi - lo > LEAF and (b > a).any():
                mid = (hi - lo) // 2
                order[lo:hi] = order[lo:hi][np.argpartition(rows[:, int(np.argmax(b - a))], mid)]
                todo += [(lo, lo + mid, node, 0), (lo + mid, hi, node, 1)]
        self.low, self.high = np.array(self.low), np.array(self.high)
        self.vectors, self.ids = vectors[order], ids[order]

    def search(self, query: np.ndarray, own: int | None, k: int, best: list[tuple]) -> None:
        """Merge this tree's rows into best: a heap of (score, -id) of k at most, its smallest first."""
        bounds = np.maximum(query * self.low, query * self.high).sum(axis=1)
        heap = [(-bounds[0], 0)]
        while heap:
            bound, node = heapq.heappop(heap)
            if len(best) >= k and -bound < best[0][0]:
                return  # nor can any other box
            left, right = self.children[node]
            if left >= 0:
                for child in (left, right):
                    if len(best) < k or bounds[child] >= best[0][0]:
                        heapq.heappush(heap, (-bounds[child], child))
                continue
            lo, hi = self.span[node]
            scores = self.vectors[lo:hi] @ query
            at = np.flatnonzero(scores >= best[0][0]) if len(best) >= k else np.arange(hi - lo)
            for i in at.tolist():
                vec_id = self.ids[lo + i]
                if own is not None and vec_id == own:
                    continue
                item = (scores[i], -vec_id)
                if len(best) < k:
                    heapq.heappush(best, item)
                elif item > best[0]:
                    heapq.heapreplace(best, item)


def integers(vector: Column, scale: float) -> Column:
    """floor(scale * x) of each component as doubles; null for vectors that take no part."""
    x = F.transform(vector, lambda v: F.floor(v.cast("double") * F.lit(scale)).cast("double"))
    bad = F.exists(vector, lambda v: v.isNull() | F.isnan(v) | (F.abs(v.cast("double")) == float("inf")))
    return F.when(~bad, x)


def _matrix(column: pd.Series) -> np.ndarray:
    """Exact arithmetic: doubles where every sum of products is below 2**53, Python integers beyond."""
    m = np.array([np.asarray(v, np.float64) for v in column])
    return m.reshape(len(column), -1)


def _exact(m: np.ndarray, other: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    top = float(np.abs(m).max(initial=0)) * float(np.abs(other).max(initial=0)) * max(1, m.shape[1])
    if top < 2.0**53:
        return m, other
    whole = np.vectorize(int, otypes=[object])
    return whole(m) if m.size else m, whole(other) if other.size else other


NULL_ID = 2**63  # after all other ids


def _search_groups(k: int, seed: bool):
    """For cogroups by (length, shard): the shard's rows and the queries that come to it."""

    def run(key, rows: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(rows) and len(queries):
            ids = np.array([NULL_ID if pd.isna(i) else int(i) for i in rows["vec_id"]], object)
            vectors, asked = _exact(_matrix(rows["x"]), _matrix(queries["x"]))
            tree = KDTree(vectors, ids)
            for own, q, kth in zip(queries["query_id"], asked, queries["kth"], strict=True):
                best: list[tuple] = []
                if not seed and not pd.isna(kth):  # stands for k rows that are known elsewhere
                    best = [(int(kth), -2 * NULL_ID)] * k
                tree.search(q, int(own), k, best)
                out += [(int(own), None if -i == NULL_ID else int(-i), max(-LIMIT - 1, min(LIMIT, int(s)))) for s, i in best if -i <= NULL_ID]
        return pd.DataFrame(out, columns=["query_id", "vec_id", "score"]).astype({"query_id": "int64", "vec_id": "Int64", "score": "int64"})

    return run


def _top(found: DataFrame, k: int) -> DataFrame:
    """The k best of each query; a few rows per shard come in, not the candidates."""
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), F.col("vec_id").asc_nulls_last())
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int"), "vec_id", "score")


def top_k(rows: DataFrame, queries: DataFrame, spark: SparkSession, k: int = 10, scale: float = 1024.0) -> DataFrame:
    """rows(vec_id, embedding), queries(query_id, embedding) -> (query_id, rank, vec_id, score)."""
    ready = rows.select("vec_id", integers(F.col("embedding"), scale).alias("x")).where("x is not null")
    ready = ready.withColumn("dim", F.size("x"))
    shards = max(1, -(-ready.count() // SHARD))
    ready = materialize(ready.withColumn("shard", F.pmod(F.xxhash64("x", "vec_id"), F.lit(shards)).cast("int")), spark)
    asked = queries.select("query_id", integers(F.col("embedding"), scale).alias("x")).where("x is not null and query_id is not null").dropDuplicates(["query_id"])
    asked = materialize(asked.withColumn("dim", F.size("x")).withColumn("block", F.pmod(F.xxhash64("query_id"), F.lit(shards)).cast("int")), spark)
    kind = "query_id long, vec_id long, score long"

    # A first round on one shard: its kth score bounds the others.
    first = asked.select("query_id", "x", "dim", F.col("block").alias("shard"), F.lit(None).cast("long").alias("kth"))
    seeded = ready.groupBy("dim", "shard").cogroup(first.groupBy("dim", "shard")).applyInPandas(_search_groups(k, True), kind)
    seeded = materialize(seeded, spark)
    kth = seeded.groupBy("query_id").agg(F.min("score").alias("kth"), F.count("*").alias("n"))
    bounded = asked.join(kth.select("query_id", F.when(F.col("n") >= k, F.col("kth")).alias("kth")), "query_id", "left")
    if shards == 1:
        return _top(seeded, k)
    # Blocks of queries against all other shards. A shard's queries are split so that no group grows with them.
    others = bounded.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1)))).where("shard <> block")
    splits = max(1, -(-asked.count() // (QUERIES * 64)))
    others = others.withColumn("split", F.pmod(F.xxhash64("query_id", F.lit(1)), F.lit(splits)).cast("int")).drop("block")
    spread = ready.withColumn("split", F.explode(F.sequence(F.lit(0), F.lit(splits - 1))))
    found = spread.groupBy("dim", "shard", "split").cogroup(others.groupBy("dim", "shard", "split")).applyInPandas(_search_groups(k, False), kind)
    return _top(seeded.unionByName(found), k)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    return top_k(rows, rows.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), "embedding"), spark)


ORACLE = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS x FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, v.vec_id, list_dot_product(q.x, v.x)::BIGINT AS score
  FROM v q JOIN v ON len(q.x) = len(v.x) AND q.vec_id <> v.vec_id WHERE q.vec_id % 100 = 0
), r AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS n FROM s
)
SELECT query_id, n::INTEGER AS rank, vec_id, score FROM r WHERE n <= 10
"""
