"""Approximate nearest neighbours by largest inner product: vantage-point trees per shard, relaxed pruning.

A vector x of a shard becomes (x, sqrt(M^2 - |x|^2)), M the largest norm there, and a search vector is scaled to norm M, so
the order of inner products is the order of Euclidean distances and the triangle inequality holds. A node keeps one
vantage point and the least and largest distance to it in either half; a half is skipped when the inequality puts it
farther away than ``factor`` times the distance of the last neighbour found so far. Factor one skips only what cannot hold
a neighbour and so is exact; less skips more.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from feedwright.llm import vectors as V
from feedwright.llm.common import query, table

NEIGHBOURS = 20
FACTOR = 0.25
LEAF = 64
SLACK = 8  # neighbours kept beyond those wanted, so that rounding cannot lose a tie
QUERY_STEP = 20


class VantagePointTree:
    """A balanced tree over rows of ``points``; ``order`` maps its places to rows."""

    def __init__(self, points: np.ndarray, leaf: int = LEAF, seed: int = 1):
        self.order = np.arange(len(points))
        self.largest = float(np.sqrt((points * points).sum(axis=1).max())) if len(points) else 0.0
        lift = np.sqrt(np.maximum(0.0, self.largest**2 - (points * points).sum(axis=1)))
        self.points = np.column_stack([points, lift])
        self.nodes: list[tuple] = []  # (low, high, None) or (low, high, middle, left range, right range, left, right)
        self.leaf, rng = leaf, np.random.default_rng(seed)
        self.root = self._build(0, len(points), rng)

    def _build(self, low: int, high: int, rng: np.random.Generator) -> int:
        if high - low <= self.leaf:
            self.nodes.append((low, high, None))
            return len(self.nodes) - 1
        own = self.points[low:high]
        # Of a few candidates, the one whose distances to a sample spread most.
        tried = rng.integers(0, len(own), 5)
        sample = own[rng.integers(0, len(own), 50)]
        spread = ((own[tried][:, None, :] - sample[None]) ** 2).sum(axis=2).var(axis=1)
        self._swap(low, low + int(tried[np.argmax(spread)]))
        apart = np.sqrt(np.maximum(0.0, ((self.points[low + 1 : high] - self.points[low]) ** 2).sum(axis=1)))
        half = len(apart) // 2
        by = np.argpartition(apart, half)
        self.points[low + 1 : high] = self.points[low + 1 : high][by]
        self.order[low + 1 : high] = self.order[low + 1 : high][by]
        apart, middle = apart[by], low + 1 + half
        ranges = (apart[:half].min(), apart[:half].max()), (apart[half:].min(), apart[half:].max())
        left, right = self._build(low + 1, middle, rng), self._build(middle, high, rng)
        self.nodes.append((low, high, middle, *ranges, left, right))
        return len(self.nodes) - 1

    def _swap(self, a: int, b: int) -> None:
        self.points[[a, b]], self.order[[a, b]] = self.points[[b, a]], self.order[[b, a]]

    def search(self, searches: np.ndarray, k: int, factor: float) -> tuple[np.ndarray, np.ndarray]:
        """(rows, scaled inner products) of the ``k`` nearest rows found for each search, in no order; -1 where none is.

        All searches go down together. First each goes to the leaf on its own side of every vantage point, for a first bound;
        then every node takes, once, those searches that do not skip it.
        """
        n = len(searches)
        norms = np.sqrt((searches * searches).sum(axis=1))
        scaled = np.column_stack([searches * (self.largest / norms)[:, None], np.zeros(n)])
        rows, scores = np.full((n, k), -1), np.full((n, k), -np.inf)
        least = np.full(n, -np.inf)  # score of the last neighbour kept
        twice = 2 * self.largest**2
        margin = 1e-7 * max(self.largest, 1e-300)

        def take(who: np.ndarray, low: int, high: int, found: np.ndarray) -> None:
            better = found.max(axis=1) > least[who]
            if not better.any():
                return
            who, found = who[better], found[better]
            both = np.concatenate([scores[who], found], axis=1)
            names = np.concatenate([rows[who], np.broadcast_to(np.arange(low, high), found.shape)], axis=1)
            top = np.argpartition(-both, k - 1, axis=1)[:, :k]
            scores[who], rows[who] = np.take_along_axis(both, top, axis=1), np.take_along_axis(names, top, axis=1)
            least[who] = scores[who].min(axis=1)

        def bounds(node: int, who: np.ndarray, score: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            """Least distance that each half can have, by its range of distances to the vantage point."""
            apart = np.sqrt(np.maximum(0.0, twice - 2 * score))
            return tuple(np.maximum(0.0, np.maximum(apart - most, least_ - apart)) for least_, most in self.nodes[node][3:5])

        home = np.full(n, -1)
        stack = [(self.root, np.arange(n))] if len(self.order) else []
        while stack:
            node, who = stack.pop()
            low, high, middle, *rest = self.nodes[node]
            if not len(who):
                continue
            if middle is None:
                take(who, low, high, scaled[who] @ self.points[low:high].T)
                home[who] = node
                continue
            to_left, to_right = bounds(node, who, scaled[who] @ self.points[low])
            stack += [(rest[2], who[to_left <= to_right]), (rest[3], who[to_left > to_right])]
        stack = [(self.root, np.arange(n), np.zeros(n))] if len(self.order) else []
        while stack:
            node, who, bound = stack.pop()
            reach = np.sqrt(np.maximum(0.0, twice - 2 * np.maximum(least[who], -self.largest**2)))
            who = who[(bound <= factor * reach + margin) | np.isneginf(least[who])]
            low, high, middle, *rest = self.nodes[node]
            if middle is None:
                who = who[home[who] != node]
                if len(who):
                    take(who, low, high, scaled[who] @ self.points[low:high].T)
            elif len(who):
                score = scaled[who] @ self.points[low]
                take(who, low, low + 1, score[:, None])
                to_left, to_right = bounds(node, who, score)
                halves = [(rest[2], who, to_left), (rest[3], who, to_right)]
                stack += halves if (to_left > to_right).sum() * 2 > len(who) else halves[::-1]
        return np.where(rows >= 0, self.order[rows], -1), scores


class Shard:
    """The distinct vectors of a shard in a tree, with the ids that carry each."""

    def __init__(self, rows: pa.Table):
        data = V.matrix(rows.column("vec").combine_chunks())
        ids = rows.column("id").to_numpy()
        self.points, where = np.unique(data, axis=0, return_inverse=True)
        owners = np.unique(np.column_stack([where.reshape(-1), ids]), axis=0)
        self.ids = owners[:, 1]
        self.starts = np.searchsorted(owners[:, 0], np.arange(len(self.points) + 1))
        self.tree = VantagePointTree(self.points)

    def nearest(self, asked: pa.Table, k: int, factor: float) -> pa.Table:
        """At most ``k`` (query_id, vec_id, score) per search: best scores first, ties to smaller ids, never the own id."""
        names, at = np.unique(asked.column("id").to_numpy(), return_index=True)
        wanted = V.matrix(asked.column("vec").combine_chunks())[at]
        width = min(k + 1 + SLACK, len(self.points))
        rows, _ = self.tree.search(wanted, width, factor)
        who, place = np.nonzero(rows >= 0)
        point = rows[who, place]
        # The first k + 1 ids of a vector: what more carry it cannot be among the k nearest.
        many = np.minimum(np.diff(self.starts)[point], k + 1)
        each = np.repeat(np.arange(len(point)), many)
        nth = np.arange(len(each)) - np.repeat(np.cumsum(many) - many, many)
        who, vec_id = who[each], self.ids[self.starts[point[each]] + nth]
        # Row by row, so that equal vectors get equal scores wherever they stand.
        score = (wanted[who] * self.points[point[each]]).sum(axis=1)
        keep = vec_id != names[who]
        who, vec_id, score = who[keep], vec_id[keep], score[keep]
        order = np.lexsort([vec_id, -score, who])
        who, vec_id, score = who[order], vec_id[order], score[order]
        rank = np.arange(len(who)) - np.searchsorted(who, who)
        best = rank < k
        return pa.table({"query_id": names[who][best], "vec_id": vec_id[best], "score": score[best]})


def nearest_neighbours(
    rows: DataFrame, searches: DataFrame, *, key: str = "vec_id", vector: str = "embedding", k: int = NEIGHBOURS, factor: float = FACTOR
) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` nearest rows found for each search, those of its own id left out.

    Vectors that are null, empty, zero or hold a null or non-finite component, and rows without an id, take no part. Rows
    that repeat id and vector count once; of several vectors with one id any may be found, and a search with several is
    made with one of them. Ties go to the smaller id. All vectors must have one length. Other columns, of any name, are
    not read. A table of no rows gives none; fewer than ``k`` candidates are all returned.
    """

    def fit(df: DataFrame) -> DataFrame:
        own = df.select(F.col(f"`{key}`").cast("long").alias("id"), F.col(f"`{vector}`").cast("array<double>").alias("vec"))
        return own.where(F.col("id").isNotNull() & V.usable(F.col("vec")) & F.exists("vec", lambda x: x != 0))

    rows, searches = fit(rows), fit(searches)
    packed = V.blocks(searches, searches.count(), "id")
    answer = lambda shard, asked: shard.nearest(asked, k, factor)
    found = V.search_shards(rows, "id", packed, V.shard_count(rows.count()), Shard, answer, "query_id long, vec_id long, score double")
    best = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")


@query("op11_vantage_point_search")
def op11_vantage_point_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest of every vector whose id is divisible by 20, among all vectors."""
    rows = table(spark, sf_dir, "embeddings")
    return nearest_neighbours(rows, rows.where(F.col("vec_id") % QUERY_STEP == 0))
