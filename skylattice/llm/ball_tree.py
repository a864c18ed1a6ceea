"""Exact inner-product search by ball trees, branch and bound.

Candidates are dealt to shards of about ``SHARD_ROWS`` by a hash of their id. A task builds the
ball tree of its shard: nodes have a centre and a radius, and no vector of a node has an inner
product with q above q.centre + |q| radius. Queries go down the tree together; at every node those
go on whose bound reaches their k-th score so far, the child with the higher bound first, and at a
leaf one matrix product scores them.

Shards share the k-th score in two waves: every query first searches one shard; its k-th score
there is a lower limit for all the others, which start with it.

Scores are exact: components are whole numbers, held in doubles (the sums must stay below 2^53).
Ties go to the smaller id. Defined results: vectors that are null, empty or hold null or
non-finite components take no part; vectors are compared with those of their own length; a query
never meets rows of its own id; with fewer than k candidates all are returned.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skylattice.llm.common import materialize

SHARD_ROWS = 8_192
LEAF_ROWS = 128
QUERY_ROWS = 16_384  # queries that a task gets, about
QUERY_BLOCK = 2_048  # queries that go down a tree together
SLACK = 1e-6  # relative rounding of the bounds; scores themselves are exact


class Ball:
    """A node over the rows ``low`` to ``high`` of the reordered vectors."""

    __slots__ = ("low", "high", "centre", "radius", "children")

    def __init__(self, vectors: np.ndarray, order: np.ndarray, low: int, high: int) -> None:
        own = vectors[order[low:high]]
        self.low, self.high, self.children = low, high, ()
        self.centre = own.mean(0)
        self.radius = float(np.sqrt(((own - self.centre) ** 2).sum(1).max()))
        if high - low > LEAF_ROWS and self.radius > 0:
            # between the two vectors farthest apart from a first one's view, at the middle
            first = own[((own - self.centre) ** 2).sum(1).argmax()]
            second = own[((own - first) ** 2).sum(1).argmax()]
            side = own @ (second - first)
            half = (high - low) // 2
            order[low:high] = order[low:high][np.argpartition(side, half)]
            self.children = (Ball(vectors, order, low, low + half), Ball(vectors, order, low + half, high))

    def bound(self, queries: np.ndarray, norms: np.ndarray) -> np.ndarray:
        """Highest score that a vector of this node can have, per query."""
        upper = queries @ self.centre + norms * self.radius
        return upper + SLACK * (1 + np.abs(upper) + norms * (self.radius + np.abs(self.centre).max()))


class Best:
    """The k best (score, position) per query; positions follow the ids, so lower ones win ties."""

    def __init__(self, n: int, k: int, floor: np.ndarray) -> None:
        self.score = np.full((n, k), -np.inf)
        self.place = np.full((n, k), np.iinfo(np.int64).max)
        self.floor = floor

    def limit(self, rows: np.ndarray) -> np.ndarray:
        """What a candidate must reach to matter."""
        return np.maximum(self.floor[rows], self.score[rows, -1])

    def offer(self, rows: np.ndarray, scores: np.ndarray, places: np.ndarray) -> None:
        k = self.score.shape[1]
        score = np.concatenate([self.score[rows], scores], 1)
        place = np.concatenate([self.place[rows], np.broadcast_to(places, scores.shape)], 1)
        order = np.lexsort((place, -score), axis=1)[:, :k]
        self.score[rows], self.place[rows] = np.take_along_axis(score, order, 1), np.take_along_axis(place, order, 1)


def search(ids: np.ndarray, vectors: np.ndarray, query_ids: np.ndarray, queries: np.ndarray, floor: np.ndarray, k: int) -> list[tuple[int, int, int]]:
    """(query, id, score) of the best ``k`` of a shard for every query that reach its floor."""
    by_id = np.argsort(ids, kind="stable")
    ids, vectors = ids[by_id], vectors[by_id]
    order = np.arange(len(ids))
    tree = Ball(vectors, order, 0, len(ids))
    out: list[tuple[int, int, int]] = []
    for start in range(0, len(query_ids), QUERY_BLOCK):
        block = slice(start, start + QUERY_BLOCK)
        q, own = queries[block], query_ids[block]
        norms = np.sqrt((q**2).sum(1))
        best = Best(len(q), k, floor[block])
        todo = [(tree, np.arange(len(q)), tree.bound(q, norms))]
        while todo:
            node, rows, bound = todo.pop()
            go = bound >= best.limit(rows)
            rows = rows[go]
            if not len(rows):
                continue
            if node.children:
                bounds = [child.bound(q[rows], norms[rows]) for child in node.children]
                first = bounds[0].mean() >= bounds[1].mean()
                todo += [(node.children[i], rows, bounds[i]) for i in ((1, 0) if first else (0, 1))]
                continue
            places = np.sort(order[node.low : node.high])
            scores = q[rows] @ vectors[places].T
            scores[(own[rows][:, None] == ids[places][None, :]) | (scores < best.limit(rows)[:, None])] = -np.inf
            some = np.flatnonzero((scores > -np.inf).any(1))
            if len(some):
                found = np.where(scores[some] > -np.inf, places, np.iinfo(np.int64).max)
                keep = min(scores.shape[1], max(k, int((scores[some] > -np.inf).sum(1).max())))
                top = np.argsort(-scores[some], axis=1, kind="stable")[:, :keep]
                best.offer(rows[some], np.take_along_axis(scores[some], top, 1), np.take_along_axis(found, top, 1))
        for row, col in zip(*np.nonzero(best.score > -np.inf), strict=True):
            out.append((int(own[row]), int(ids[best.place[row, col]]), int(best.score[row, col])))
    return out


_FOUND = "query_id long, vec_id long, score long"


def shard_search(k: int) -> Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame]:
    """Searches one shard's tree for the queries that come to it."""

    def work(candidates: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        if candidates.empty or queries.empty:
            return pd.DataFrame({c: pd.Series(dtype="int64") for c in ("query_id", "vec_id", "score")})
        vectors, wanted = (np.array(side["whole"].tolist(), np.float64) for side in (candidates, queries))
        found = search(candidates["vec_id"].to_numpy(), vectors, queries["query_id"].to_numpy(), wanted, queries["floor"].to_numpy(), k)
        return pd.DataFrame(found, columns=["query_id", "vec_id", "score"], dtype="int64")

    return work


def whole_numbers(embeddings: DataFrame, scale: int) -> DataFrame:
    """(vec_id, width, whole) of the vectors that take part: components are floor(scale * x)."""
    x = F.transform("embedding", lambda v: v.cast("double"))
    usable = F.col("vec_id").isNotNull() & (F.size("embedding") > 0) & F.forall(x, lambda v: v.isNotNull() & (F.abs(v) < float("inf")))
    return embeddings.where(usable).select(F.col("vec_id").cast("long").alias("vec_id"), F.size("embedding").alias("width"), F.transform(x, lambda v: F.floor(v * scale).cast("double")).alias("whole"))


def top_inner_products(vectors: DataFrame, every: int, k: int) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` highest scores of every vector whose id is divisible by ``every``."""
    rows = materialize(vectors, "vectors")
    is_query = F.pmod("vec_id", F.lit(every)) == 0
    counts = rows.groupBy("width").agg(F.count("*").alias("n"), F.count_if(is_query).alias("q"))
    counts = counts.select("width", F.ceil(F.col("n") / SHARD_ROWS).cast("int").alias("shards"), F.greatest(F.ceil(F.col("q") / QUERY_ROWS), F.lit(1)).cast("int").alias("blocks"))
    sized = rows.join(counts, "width").withColumn("block", F.pmod(F.xxhash64("vec_id", F.lit(5)), F.col("blocks")).cast("int"))
    # a task holds one shard and one block of queries, both of bounded size
    candidates = sized.select("width", F.pmod(F.xxhash64("vec_id"), F.col("shards")).cast("int").alias("shard"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), "vec_id", "whole")
    queries = sized.where(is_query).select("width", "shards", "block", F.col("vec_id").alias("query_id"), "whole", F.pmod(F.xxhash64("vec_id", F.lit(3)), F.col("shards")).cast("int").alias("home"))
    keys = ["width", "shard", "block"]
    lowest = F.lit(float("-inf"))
    at_home = queries.select("width", F.col("home").alias("shard"), "block", "query_id", "whole", lowest.alias("floor"))
    first = materialize(candidates.groupBy(*keys).cogroup(at_home.toDF(*at_home.columns).groupBy(*keys)).applyInPandas(shard_search(k), _FOUND), "first_wave")
    limits = first.groupBy("query_id").agg(F.when(F.count("*") >= k, F.min("score").cast("double")).otherwise(lowest).alias("floor"))
    others = F.filter(F.sequence(F.lit(0), F.col("shards") - 1), lambda s: s != F.col("home"))
    away = queries.join(limits, "query_id", "left").select("width", F.explode(others).alias("shard"), "block", "query_id", "whole", F.coalesce("floor", lowest).alias("floor"))
    second = candidates.groupBy(*keys).cogroup(away.toDF(*away.columns).groupBy(*keys)).applyInPandas(shard_search(k), _FOUND)
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return first.unionByName(second).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
