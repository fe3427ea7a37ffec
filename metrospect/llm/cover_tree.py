"""Exact top-k by inner product with two cover trees.

Components become floor(1024 * x), so scores are whole numbers. Queries and data are cut into blocks; a task
gets a block of each, builds a cover tree of both (children lie within the parent's radius divided by EXPANSION
and are at least that far apart) and walks pairs of nodes. A pair is pruned if even the largest inner product
that its centres and covering radii allow stays below the worst k-th score of the query group; a leaf of
queries is tested query by query. The per-block results of a query, at most k rows each, are merged by a
window per query.

The number of blocks follows the number of components, so a task's memory is bounded by BLOCK_BYTES of them a side,
whatever the width; every query block meets every data block once (a stated query set against all rows).

Defined cases: vectors that are null, empty or hold null or non-finite components take no part, nor do rows
without vec_id; rows of one vec_id count once, with the smallest vector; a query meets candidates of its
own number of components; fewer candidates than k: all of them; scores must fit 64 bits, larger ones raise OverflowError; an empty table gives an empty result; other
columns are not read.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from metrospect.session import staged

EXPANSION = 1.2
LEAF = 64
QUERY_LEAF = 256
BLOCK_BYTES = 16 << 20
LEAST_BLOCKS = 6
SCALE = 1024
EXACT = 2.0**53


def whole_vectors(table: DataFrame, scale: int = SCALE) -> DataFrame:
    """vec_id and v, the floors of the scaled components, of all rows that take part."""
    component = lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf"))
    usable = table.where(F.col("vec_id").isNotNull() & (F.size("embedding") > 0) & F.forall("embedding", component))
    v = F.transform("embedding", lambda x: F.floor(x.cast("double") * scale))
    return usable.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v")).groupBy("vec_id").agg(F.min("v").alias("v"))


class Node:
    """A ball around a point: `points` (positions) of a leaf, or children."""

    __slots__ = ("centre", "radius", "longest", "points", "children", "balls", "leaves")

    def __init__(self, centre: np.ndarray, radius: float, longest: float, points: np.ndarray, children: list[Node]):
        self.centre, self.radius, self.longest, self.points, self.children = centre, radius, longest, points, children
        if children:
            self.balls = Balls(
                np.stack([child.centre for child in children]), np.array([child.radius for child in children]),
                np.array([child.longest for child in children]))
            self.leaves = np.array([not child.children for child in children])


class Balls:
    """Centres, radii and longest norms of several balls."""

    def __init__(self, centres: np.ndarray, radii: np.ndarray, longest: np.ndarray):
        self.centres, self.radii, self.longest = centres, radii, longest
        self.norms = np.sqrt((centres * centres).sum(axis=1))

    @classmethod
    def of(cls, node: Node) -> Balls:
        return cls(node.centre[None, :], np.array([node.radius]), np.array([node.longest]))

    def bounds(self, other: Balls) -> np.ndarray:
        """The largest inner product that a point of each ball can have with one of each other ball: by the
        centres' product and the radii, and by the least distance and the longest norms."""
        products = self.centres @ other.centres.T
        near, far = self.radii[:, None], other.radii[None, :]
        by_product = products + self.norms[:, None] * far + near * other.norms[None, :] + near * far
        squares = self.norms[:, None] ** 2 + other.norms[None, :] ** 2 - 2 * products
        apart = np.maximum(np.sqrt(np.maximum(squares, 0.0)) - near - far, 0.0)
        by_distance = (self.longest[:, None] ** 2 + other.longest[None, :] ** 2 - apart**2) / 2
        return np.minimum(by_product, by_distance)


def cover_tree(x: np.ndarray, expansion: float = EXPANSION, leaf: int = LEAF) -> Node:
    """The cover tree of the rows of x; points at distance 0 of their centre share a leaf."""

    squares = (x * x).sum(axis=1)
    norms = np.sqrt(squares)
    # Distances come from products; below this share of the squares they are rounding.
    least = 1e-12 * float(squares.max(initial=0.0))

    def apart(rows: np.ndarray, of: np.ndarray, centre: int) -> np.ndarray:
        found = of + squares[centre] - 2 * (rows @ x[centre])
        return np.sqrt(np.where(found > least, found, 0.0))

    def build(points: np.ndarray, distances: np.ndarray) -> Node:
        """points[0] is the centre, distances are to it."""
        radius, longest = float(distances.max()), float(norms[points].max())
        if len(points) <= leaf or radius == 0.0:
            return Node(x[points[0]], radius, longest, points, [])
        reach, children = radius / expansion, []
        rest, far, centre = points, distances, points[0]
        rows, of = x[rest], squares[rest]
        while len(rest):
            near = apart(rows, of, centre)
            mine = near <= reach
            mine[rest == centre] = True
            own = rest[mine]
            order = np.argsort(own != centre, kind="stable")
            children.append(build(own[order], near[mine][order]))
            left = ~mine
            rest, far = rest[left], np.minimum(far, near)[left]
            rows, of = rows[left], of[left]
            if len(rest):
                centre = rest[int(far.argmax())]
        return Node(x[points[0]], radius, longest, points, children)

    everything = np.arange(len(x))
    return build(everything, apart(x, squares, 0))


class Search:
    """Best k data rows for each query row, by score, then id."""

    def __init__(self, q: np.ndarray, q_ids: np.ndarray, d: np.ndarray, d_ids: np.ndarray, k: int):
        self.q_ids, self.d_ids, self.k = q_ids, d_ids, k
        self.q, self.d = q.astype(np.float64), d.astype(np.float64)
        largest = float(max(np.abs(self.q).max(initial=0.0), np.abs(self.d).max(initial=0.0)))
        self.fits = largest * largest * q.shape[1] < EXACT
        self.whole = None if self.fits else (q.astype(np.int64).astype(object), d.astype(np.int64).astype(object))
        self.q_norms = np.sqrt((self.q ** 2).sum(axis=1))
        self.scores = np.full((len(q), k), -np.inf, np.float64 if self.fits else object)
        self.found = np.full((len(q), k), np.iinfo(np.int64).max)
        self.slack = 1e-9 * largest * largest * q.shape[1] + 1e-6

    def products(self, rows: np.ndarray, columns: np.ndarray) -> np.ndarray:
        """Inner products of whole numbers: exact in doubles while they fit, in Python's integers beyond."""
        if self.whole is None:
            return self.q[rows] @ self.d[columns].T
        return self.whole[0][rows] @ self.whole[1][columns].T

    def order(self, scores: np.ndarray, ids: np.ndarray) -> np.ndarray:
        """Positions by falling score, then rising id."""
        if self.fits:
            return np.lexsort((ids, -scores))
        return np.array(sorted(range(len(ids)), key=lambda i: (-scores[i], ids[i])))

    def worst(self, node: Node) -> float:
        return float(self.scores[node.points, -1].min())

    def meet(self, rows: np.ndarray, columns: np.ndarray) -> None:
        for part in range(0, len(columns), 4096):
            some = columns[part:part + 4096]
            scores = self.products(rows, some)
            ids = self.d_ids[some]
            wanted = (scores >= self.scores[rows, -1][:, None]) & (ids[None, :] != self.q_ids[rows][:, None])
            for i in np.flatnonzero(wanted.any(axis=1)):
                row, new = rows[i], wanted[i]
                all_scores = np.concatenate([self.scores[row], scores[i][new]])
                all_ids = np.concatenate([self.found[row], ids[new]])
                best = self.order(all_scores, all_ids)[:self.k]
                self.scores[row], self.found[row] = all_scores[best], all_ids[best]

    def run(self) -> None:
        """Walk node pairs, the most promising data first. A leaf of queries bounds each of its queries, and
        meets the points of all useful leaves below a node at once."""
        waiting = [(cover_tree(self.q, leaf=QUERY_LEAF), cover_tree(self.d), np.inf)]
        while waiting:
            queries, data, bound = waiting.pop()
            if bound + self.slack < self.worst(queries):
                continue
            if queries.children and (not data.children or queries.radius * EXPANSION > data.radius):
                bounds = queries.balls.bounds(Balls.of(data))[:, 0]
                waiting += [(child, data, b) for child, b in zip(queries.children, bounds)]
            elif queries.children:
                bounds = Balls.of(queries).bounds(data.balls)[0]
                waiting += [(queries, data.children[i], bounds[i]) for i in np.argsort(bounds)]
            else:
                points, kth = queries.points, self.scores[queries.points, -1].astype(np.float64)
                each = Balls(self.q[points], np.zeros(len(points)), self.q_norms[points])
                if data.children:
                    bounds = each.bounds(data.balls)
                    open_pairs = bounds + self.slack >= kth[:, None]
                    useful, best = open_pairs.any(axis=0), bounds.max(axis=0)
                    at_once = np.flatnonzero(useful & data.leaves)
                    if len(at_once):
                        asking = open_pairs[:, at_once].any(axis=1)
                        self.meet(points[asking], np.concatenate([data.children[i].points for i in at_once]))
                    waiting += [(queries, data.children[i], best[i]) for i in np.argsort(best) if useful[i] and not data.leaves[i]]
                else:
                    useful = each.bounds(Balls.of(data))[:, 0] + self.slack >= kth
                    self.meet(points[useful], data.points)


def top_k(table: DataFrame, every: int, k: int, scale: int = SCALE, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """query_id, rank, vec_id, score: the k best candidates of each row whose vec_id divides by `every`."""
    vectors = staged(whole_vectors(table, scale).withColumn("dim", F.size("v")), "cover-vectors")
    asking = F.pmod("vec_id", F.lit(every)) == 0
    row_bytes = 8 * F.col("dim").cast("long")
    sizes = vectors.agg(F.sum(row_bytes).alias("data"), F.sum(F.when(asking, row_bytes)).alias("queries")).first()
    data_blocks = max(LEAST_BLOCKS, -(-(sizes["data"] or 0) // block_bytes))
    query_blocks = max(1, -(-(sizes["queries"] or 0) // block_bytes))
    deal = lambda n: F.pmod(F.xxhash64("vec_id"), F.lit(n)).cast("int")
    all_of = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    data = vectors.withColumn("of_data", deal(data_blocks)).withColumn("of_queries", all_of(query_blocks))
    queries = vectors.where(asking).withColumn("of_queries", deal(query_blocks)).withColumn("of_data", all_of(data_blocks))
    keys = ["dim", "of_data", "of_queries"]

    def search(asked: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
        columns = ["query_id", "vec_id", "score"]
        if asked.empty or held.empty:
            return pd.DataFrame(columns=columns).astype("int64")
        rows = lambda frame: np.stack(frame["v"].to_list())
        found = Search(rows(asked), asked["vec_id"].to_numpy(), rows(held), held["vec_id"].to_numpy(), k)
        found.run()
        real = np.isfinite(found.scores.astype(np.float64))
        at, _ = np.nonzero(real)
        return pd.DataFrame({"query_id": found.q_ids[at], "vec_id": found.found[real], "score": found.scores[real].astype(np.int64)})

    partial = queries.groupBy(*keys).cogroup(data.groupBy(*keys)).applyInPandas(search, "query_id long, vec_id long, score long")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = partial.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
