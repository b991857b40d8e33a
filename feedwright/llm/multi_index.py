"""Hard-negative mining with an inverted multi-index that certifies its answers.

Vectors are split into two halves, each with a codebook of its own (k-means on a bounded sample); a pair of codewords is
a cell. By Cauchy-Schwarz a row's half score is at most that of its codeword plus the search's half norm times the largest
residual of the codeword, the radius. A multi-sequence heap yields cells in falling order of the sum of both half bounds;
the walk of a search stops once its results are certified, when no cell left can hold a row that would change them. So
answers are exact whatever the codebooks are; these decide only how soon a walk ends.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from feedwright.llm import vectors as V
from feedwright.llm.common import query, table

CODEWORDS = 16
SAMPLE_ROWS = 8192
CELLS_AT_ONCE = 16
POSITIVES = 5
NEGATIVES = 10
WINDOW = (30, 90)  # percent of the positive's score
SCALE = 256
ANCHOR_STEP = 100


def k_means(points: np.ndarray, k: int, rounds: int = 8, seed: int = 1) -> np.ndarray:
    """At most ``k`` centres of the points; plain Lloyd rounds from distinct random points."""
    distinct = np.unique(points, axis=0)
    centres = distinct[np.random.default_rng(seed).permutation(len(distinct))[:k]]
    for _ in range(rounds if len(centres) else 0):
        own = nearest(points, centres)
        for c in np.unique(own):
            centres[c] = points[own == c].mean(axis=0)
    return centres


def nearest(points: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.argmin((centres * centres).sum(axis=1) - 2 * (points @ centres.T), axis=1)


def scaled(values: pa.Array, scale: float) -> np.ndarray:
    return np.floor(scale * V.matrix(values))


class MultiIndex:
    """The rows of a shard by cell."""

    def __init__(self, rows: pa.Table, codebooks: tuple[np.ndarray, np.ndarray], scale: float):
        data = scaled(rows.column("vec").combine_chunks(), scale)
        ids, labels = rows.column("id").to_numpy(), rows.column("label").to_numpy()
        _, first = np.unique(np.column_stack([ids, labels, data]), axis=0, return_index=True)  # repeated rows count once
        data, ids, labels = data[first], ids[first], labels[first]
        self.half = data.shape[1] // 2
        halves = data[:, : self.half], data[:, self.half :]
        codes = [nearest(part, book) for part, book in zip(halves, codebooks)]
        cell = codes[0] * len(codebooks[1]) + codes[1]
        order = np.lexsort([ids, cell])
        self.data, self.ids, self.labels = data[order], ids[order], labels[order]
        self.width = len(codebooks[1])
        self.starts = np.searchsorted(cell[order], np.arange(len(codebooks[0]) * self.width + 1))
        self.books, self.radii = codebooks, []
        for part, code, book in zip(halves, codes, codebooks):
            radius = np.full(len(book), -np.inf)  # no row: no bound reaches it
            np.maximum.at(radius, code, np.sqrt(((part - book[code]) ** 2).sum(axis=1)))
            self.radii.append(radius)
        self.largest = float(np.abs(data).max(initial=0.0))

    def scores(self, rows: np.ndarray, search: np.ndarray) -> np.ndarray:
        """Integer inner products; in doubles where every partial sum is exact, else in Python integers."""
        if self.largest * float(np.abs(search).max(initial=0.0)) * len(search) < 2**53:
            return (self.data[rows] @ search).astype(np.int64)
        own = [int(x) for x in search]
        return np.array([sum(int(x) * y for x, y in zip(line, own)) for line in self.data[rows]], dtype=np.int64)

    def walk(self, search: np.ndarray) -> Iterator[tuple[np.ndarray, float]]:
        """(rows of the next cells, largest score that any later cell can hold), best bounds first."""
        parts = search[: self.half], search[self.half :]
        bounds, orders = [], []
        for part, book, radius in zip(parts, self.books, self.radii):
            bound = np.where(np.isneginf(radius), -np.inf, book @ part + np.sqrt((part * part).sum()) * radius)
            order = np.argsort(-bound, kind="stable")
            order = order[~np.isneginf(bound[order])]
            bounds.append((bound[order] + 1e-9 * np.abs(bound[order]) + 1e-6).tolist())
            orders.append(order)
        if not bounds[0] or not bounds[1]:
            return
        (left, right), starts = bounds, self.starts
        heap, rows = [(-(left[0] + right[0]), 0, 0)], []
        while heap:
            _, i, j = heapq.heappop(heap)
            if j + 1 < len(right):
                heapq.heappush(heap, (-(left[i] + right[j + 1]), i, j + 1))
            if j == 0 and i + 1 < len(left):
                heapq.heappush(heap, (-(left[i + 1] + right[0]), i + 1, 0))
            cell = int(orders[0][i]) * self.width + int(orders[1][j])
            if starts[cell + 1] > starts[cell]:
                rows.append(np.arange(starts[cell], starts[cell + 1]))
            if len(rows) == CELLS_AT_ONCE or (rows and not heap):
                yield np.concatenate(rows), -heap[0][0] if heap else -np.inf
                rows = []

    def positives(self, name: int, label: int, search: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids, scores) of the ``k`` best other rows of the label."""
        ids, best = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
        for rows, later in self.walk(search):
            rows = rows[(self.labels[rows] == label) & (self.ids[rows] != name)]
            ids, best = _first(np.append(ids, self.ids[rows]), np.append(best, self.scores(rows, search)), k)
            if len(ids) == k and best[-1] > later:
                break
        return ids, best

    def negatives(self, name: int, label: int, search: np.ndarray, positive: np.ndarray, window: tuple[int, int], k: int) -> list[tuple[np.ndarray, np.ndarray]]:
        """Per positive score, (ids, scores) of the ``k`` best rows of other labels within its window."""
        found = [(np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64))] * len(positive)
        limits = [(window[0] * int(p), window[1] * int(p)) for p in positive]
        unsure = [n for n, (low, high) in enumerate(limits) if low <= high]
        for rows, later in self.walk(search) if unsure else ():
            rows = rows[(self.labels[rows] != label) & (self.ids[rows] != name)]
            score = self.scores(rows, search)
            for n in unsure:
                low, high = limits[n]
                inside = (100 * score >= low) & (100 * score <= high)
                if inside.any():
                    found[n] = _first(np.append(found[n][0], self.ids[rows][inside]), np.append(found[n][1], score[inside]), k)
            unsure = [n for n in unsure if 100 * later >= limits[n][0] and not (len(found[n][0]) == k and found[n][1][-1] > later)]
            if not unsure:
                break
        return found


def _first(ids: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    order = np.lexsort([ids, -scores])[:k]
    return ids[order], scores[order]


def fit_codebooks(rows: DataFrame, scale: float, k: int = CODEWORDS) -> tuple[np.ndarray, np.ndarray]:
    """Codebooks of both halves, from the ``SAMPLE_ROWS`` rows with the least hash of their id."""
    sample = rows.orderBy(F.xxhash64("id", F.lit("sample")), "id").limit(SAMPLE_ROWS).select("vec").toArrow()
    data = scaled(sample.column("vec").combine_chunks(), scale) if sample.num_rows else np.zeros((0, 2))
    half = data.shape[1] // 2
    return k_means(data[:, :half], k), k_means(data[:, half:], k)


def mine_negatives(
    rows: DataFrame,
    anchors: DataFrame,
    *,
    key: str = "vec_id",
    vector: str = "embedding",
    label: str = "label",
    positives: int = POSITIVES,
    negatives: int = NEGATIVES,
    window: tuple[int, int] = WINDOW,
    scale: float = SCALE,
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    Scores are inner products of vectors whose components x are floor(scale * x). For each anchor and each of its
    ``positives`` best rows of the same label, the ``negatives`` best rows of other labels whose score lies within
    ``window`` percent of the positive's, ties to the smaller id. Rows with a null id, label or vector, an empty vector,
    or a null or non-finite component take no part. Repeated rows count once, an anchor never meets rows of its own id,
    and of several anchors with one id one is used. All vectors must have one length, of two at least. A positive
    without such rows, and an anchor without positives, gives no row; so do tables without rows. Other columns, of any
    name, are not read.
    """

    def fit(df: DataFrame) -> DataFrame:
        own = df.select(F.col(f"`{key}`").cast("long").alias("id"), F.col(f"`{label}`").cast("long").alias("label"), F.col(f"`{vector}`").cast("array<double>").alias("vec"))
        return own.where(F.col("id").isNotNull() & F.col("label").isNotNull() & V.usable(F.col("vec")))

    rows, anchors = fit(rows), fit(anchors)
    shared = rows.sparkSession.sparkContext.broadcast(fit_codebooks(rows, scale))  # CODEWORDS centres of each half
    shards, count = V.shard_count(rows.count()), anchors.count()
    build = lambda own: MultiIndex(own, shared.value, scale)

    def each(asked: pa.Table) -> Iterator[tuple[int, int, int, np.ndarray]]:
        """(place, id, label, vector) of the anchors of a block, one of each id."""
        ids, at = np.unique(asked.column("id").to_numpy(), return_index=True)
        data, labels = scaled(asked.column("vec").combine_chunks(), scale), asked.column("label").to_numpy()
        yield from ((int(k), int(name), int(labels[k]), data[k]) for name, k in zip(ids, at))

    def best(index: MultiIndex, asked: pa.Table) -> pa.Table:
        out = [(name, *index.positives(name, own, search, positives)) for _, name, own, search in each(asked)]
        lengths = [len(ids) for _, ids, _ in out]
        none = np.zeros(0, dtype=np.int64)
        return pa.table({"anchor_id": np.repeat(np.array([name for name, _, _ in out], dtype=np.int64), lengths), "positive_id": np.concatenate([none, *[ids for _, ids, _ in out]]), "positive_score": np.concatenate([none, *[scores for _, _, scores in out]])})

    found = V.search_shards(rows, "id", V.blocks(anchors, count, "id"), shards, build, best, "anchor_id long, positive_id long, positive_score long")
    by_score = Window.partitionBy("anchor_id").orderBy(F.col("positive_score").desc(), "positive_id")
    chosen = found.withColumn("_rank", F.row_number().over(by_score)).where(F.col("_rank") <= positives).drop("_rank")
    # At most ``positives`` per anchor.
    lists = chosen.groupBy("anchor_id").agg(F.collect_list(F.struct("positive_id", "positive_score")).alias("positives"))
    asking = anchors.join(lists, anchors["id"] == lists["anchor_id"]).select("id", "label", "vec", F.col("positives.positive_id").alias("positive_ids"), F.col("positives.positive_score").alias("positive_scores"))

    def within(index: MultiIndex, asked: pa.Table) -> pa.Table:
        columns: list[list] = [[], [], [], [], []]
        for k, name, own, search in each(asked):
            ids, scores = asked.column("positive_ids")[k].as_py(), asked.column("positive_scores")[k].as_py()
            for positive, score, (rows_, values) in zip(ids, scores, index.negatives(name, own, search, scores, window, negatives)):
                for column, part in zip(columns, ([name] * len(rows_), [positive] * len(rows_), rows_.tolist(), [score] * len(rows_), values.tolist())):
                    column += part
        names = ["anchor_id", "positive_id", "negative_id", "positive_score", "negative_score"]
        return pa.table([pa.array(column, pa.int64()) for column in columns], names=names)

    hard = V.search_shards(rows, "id", V.blocks(asking, count, "id"), shards, build, within, "anchor_id long, positive_id long, negative_id long, positive_score long, negative_score long")
    order = Window.partitionBy("anchor_id", "positive_id").orderBy(F.col("negative_score").desc(), "negative_id")
    ranked = hard.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= negatives)
    return ranked.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


ORACLE = f"""
with v as (
    select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label,
           list_transform(embedding, lambda x: floor({SCALE} * x::double)) as e
    from embeddings
    where vec_id is not null and label is not null and len(embedding) > 0
      and len(list_filter(embedding, lambda x: x is null or isnan(x) or isinf(x))) = 0),
s as (
    select a.vec_id as anchor_id, r.vec_id, r.label = a.label as same, list_inner_product(a.e, r.e)::bigint as score
    from v a join v r on a.vec_id <> r.vec_id where a.vec_id % {ANCHOR_STEP} = 0),
p as (
    select anchor_id, vec_id as positive_id, score as positive_score from s where same
    qualify row_number() over (partition by anchor_id order by score desc, vec_id) <= {POSITIVES}),
n as (
    select anchor_id, positive_id, vec_id as negative_id, positive_score, score as negative_score,
           row_number() over (partition by anchor_id, positive_id order by score desc, vec_id)::integer as rank
    from p join s using (anchor_id)
    where not same and {WINDOW[0]} * positive_score <= 100 * score and 100 * score <= {WINDOW[1]} * positive_score)
select anchor_id, positive_id, rank, negative_id, positive_score, negative_score from n where rank <= {NEGATIVES}
"""


@query("op12_hard_negatives", ORACLE)
def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of every vector whose id is divisible by 100, where ids divisible by 7 have the next label."""
    rows = table(spark, sf_dir, "embeddings")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = rows.withColumn("label", moved)
    return mine_negatives(rows, rows.where(F.col("vec_id") % ANCHOR_STEP == 0))
