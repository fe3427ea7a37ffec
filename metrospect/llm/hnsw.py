"""Approximate nearest neighbours by inner product: navigable small-world graphs per shard.

Vectors are dealt to shards by hash. A shard holds one graph per norm class (norms within a factor of two) and at most
about GRAPH vectors, as the share of true neighbours that a search of fixed width finds falls with the size of a graph.
Each graph is hierarchical and built layer by layer from the top, in batches: a batch searches the graph so far, is
compared with itself, chooses diverse neighbours and is linked both ways. Links join near directions; a search walks
them by inner product. The index of a graph is one row: ids, vectors and, per layer, the flat array of neighbours.
Queries go through every graph, many side by side, and the k best are merged, first in the task of a shard, then over
all shards; scores are computed again in double precision from the original vectors.

Vectors that are equal share a node, so a vector that a third of the rows share is one node with many
ids. Shards hold SHARD_BYTES each, whatever the width of a vector; a query block and one shard meet in a task.

Defined cases: vectors that are null, empty, zero or hold null or non-finite components take no part, nor do
rows without vec_id; rows of one vec_id count once, with the smallest vector; a query meets candidates of
its own number of components; of equal scores that were met, the smaller vec_id comes first; fewer candidates than k: all
of them; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import FloatType

from metrospect.session import staged

DEGREE = 16
BUILD_WIDTH = 64
SEARCH_WIDTH = 256
GRAPH = 50_000
SHARD_BYTES = 16 << 20
LEAST_SHARDS = 8
QUERY_BYTES = 16 << 20
BATCH = 128
STEPS = 4
ENTRIES = 16
# Upper layers of no more nodes are compared whole.
SEEN_WHOLE = 512
# How much of what a norm lacks to the largest one counts in a link.
LEVEL = 0.1
# The key of no node.
NONE = np.iinfo(np.int64).min


def usable_vectors(table: DataFrame) -> DataFrame:
    """vec_id, v of the rows that take part; v is of doubles, or of floats as given."""
    component = lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf"))
    usable = table.where(
        F.col("vec_id").isNotNull() & (F.size("embedding") > 0) & F.forall("embedding", component)
        & F.exists("embedding", lambda x: x != 0))
    real = table.schema["embedding"].dataType.elementType == FloatType()
    v = F.col("embedding") if real else F.transform("embedding", lambda x: x.cast("double"))
    return usable.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v")).groupBy("vec_id").agg(F.min("v").alias("v"))


def norm_class() -> Column:
    """The power of two nearest to the norm of v by ratio, so that rounded unit vectors are of one class. Where squares
    would overflow or vanish, parts are scaled first."""
    plain = F.aggregate(
        "v", F.lit(0.0), lambda total, x: total + x.cast("double") * x.cast("double"),
        lambda total: F.when((total > 1e-250) & (total < 1e250), F.log2(total) / 2))
    most = F.array_max(F.transform("v", lambda x: F.abs(x.cast("double"))))
    squares = F.aggregate("v", F.lit(0.0), lambda total, x: total + F.pow(x / most, F.lit(2.0)))
    return F.floor(F.coalesce(plain, F.log2(most) + F.log2(squares) / 2) + 0.5).cast("int")


def levelled(x: np.ndarray) -> np.ndarray:
    """What a graph links: the directions of the rows, with one more small component that falls as the norm
    rises, so that rows of one direction are linked in the order of their norms; scaled to norm 1."""
    x = x / (np.abs(x).max(initial=0.0) or 1.0)
    norms = np.sqrt((x * x).sum(axis=1, keepdims=True))
    share = norms / (norms.max(initial=0.0) or 1.0)
    more = LEVEL * np.sqrt(1.0 - share * share)
    return (np.hstack([x / np.where(norms > 0, norms, 1.0), more]) / np.sqrt(1.0 + more * more)).astype(np.float32)


def layers_of(ids: np.ndarray, degree: int) -> np.ndarray:
    """The top layer of each node, from a hash of its id."""
    draws = np.array([xxhash.xxh64_intdigest(int(i).to_bytes(8, "little", signed=True)) for i in ids], np.float64)
    return np.floor(-np.log((draws + 1.0) / 2.0**64) / np.log(degree)).astype(int)


def packed(similar: np.ndarray, nodes: np.ndarray) -> np.ndarray:
    """Whole numbers in the order of similarity, then of node; the last bit is free, for "expanded"."""
    bits = similar.astype(np.float32).view(np.int32)
    return (bits ^ ((bits >> 31) & 0x7FFFFFFF)).astype(np.int64) << 32 | nodes.astype(np.int64) << 1


def unpacked(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nodes (-1: none) and similarities of packed keys."""
    bits = (keys >> 32).astype(np.int32)
    value = (bits ^ ((bits >> 31) & 0x7FFFFFFF)).view(np.float32)
    return np.where(keys == NONE, -1, (keys & 0xFFFFFFFF) >> 1), np.where(keys == NONE, np.float32(-np.inf), value)


def walk(x: np.ndarray, near: np.ndarray, asked: np.ndarray, entries: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Best-first search in one layer for many queries side by side: positions (-1: none) and
    similarities of the `width` best nodes met, nearest first. near holds the neighbours of each node (-1: none); there
    are at most `width` entries.

    A query's nodes are one row of packed keys, so that a step is a gather and a sort of whole numbers: a node that is
    met again has the same key, apart from the bit of those expanded."""
    rows = np.arange(len(asked))
    out = np.full((len(asked), width), NONE)
    room = np.empty((len(asked), STEPS * near.shape[1], x.shape[1]), x.dtype)
    held = np.full((len(asked), width), NONE)
    held[:, :entries.shape[1]] = np.where(entries < 0, NONE, packed(np.einsum("qd,qed->qe", asked, x[entries]), entries))
    while True:
        can = held & 1 == 0
        nodes = np.partition(np.where(can, held, NONE), width - STEPS, axis=1)[:, width - STEPS:]
        ready = nodes.max(axis=1) == NONE
        if ready.any():
            out[rows[ready]] = held[ready]
            rows, held, asked, can, nodes = rows[~ready], held[~ready], asked[~ready], can[~ready], nodes[~ready]
            if not len(rows):
                return unpacked(np.sort(out, axis=1)[:, ::-1])
        held |= can & (held >= np.maximum(nodes[:, :1], NONE + 2))
        met = near[(nodes & 0xFFFFFFFF) >> 1]
        met[nodes == NONE] = -1
        met = met.reshape(len(rows), -1)
        vectors = x.take(met, axis=0, mode="wrap", out=room[:len(rows)])
        keys = np.where(met < 0, NONE, packed(np.einsum("qd,qed->qe", asked, vectors), met))
        held = np.concatenate([held, keys], axis=1)
        held.sort(axis=1)
        node = held >> 1
        held[:, :-1][node[:, 1:] == node[:, :-1]] = NONE
        held = np.partition(held, held.shape[1] - width, axis=1)[:, -width:]


def diverse(x: np.ndarray, nodes: np.ndarray, value: np.ndarray, degree: int) -> np.ndarray:
    """Up to `degree` neighbours per row, nearest first, each nearer to the row's node than to those
    chosen before; places left over go to the nearest of the others."""
    order = np.argsort(-value, axis=1, kind="stable")
    nodes, value = np.take_along_axis(nodes, order, 1), np.take_along_axis(value, order, 1)
    vectors = x[nodes]
    hides = np.matmul(vectors, vectors.transpose(0, 2, 1)) >= value[:, None, :]
    hidden = nodes < 0
    chosen = np.zeros(nodes.shape, bool)
    left = np.full(len(nodes), degree)
    for place in range(nodes.shape[1]):
        fits = ~hidden[:, place] & (left > 0)
        chosen[:, place] = fits
        left -= fits
        hidden |= hides[:, place] & fits[:, None]
    rank = np.argsort(np.where(nodes < 0, 2, np.where(chosen, 0, 1)).astype(np.int8), axis=1, kind="stable")[:, :degree]
    picked = np.take_along_axis(nodes, rank, 1)
    if picked.shape[1] < degree:
        picked = np.hstack([picked, np.full((len(nodes), degree - picked.shape[1]), -1)])
    return picked


def nearest(nodes: np.ndarray, value: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """The `most` nodes of largest value in each row, in no order."""
    if nodes.shape[1] <= most:
        return nodes, value
    keep = np.argpartition(-value, most - 1, axis=1)[:, :most]
    return np.take_along_axis(nodes, keep, 1), np.take_along_axis(value, keep, 1)


class Index:
    """A graph: near[layer] holds the neighbours of the nodes of a layer, the uppermost first, and x what is compared:
    levelled vectors while it is built, any multiple of the vectors while it is searched."""

    def __init__(self, x: np.ndarray, near: list[np.ndarray]):
        self.x, self.near = x, near

    @classmethod
    def build(cls, x: np.ndarray, tops: np.ndarray, degree: int = DEGREE, width: int = BUILD_WIDTH) -> tuple[Index, np.ndarray]:
        """The index, and the order in which it holds the rows of x: upper layers first."""
        order = np.argsort(-tops, kind="stable")
        self = cls(x[order], [])
        sizes = [int((tops >= layer).sum()) for layer in range(int(tops.max()), -1, -1)]
        for depth, size in enumerate(sizes):
            last = depth == len(sizes) - 1
            self.near.append(self.layer(size, 2 * degree if last else degree, width))
        return self, order

    def layer(self, size: int, degree: int, width: int) -> np.ndarray:
        """Neighbours of the first `size` nodes among themselves. A batch is as large as what is linked so far: it
        walks the graph and is compared with itself."""
        x = self.x[:size]
        near = np.full((size, degree), -1, np.int32)
        done = min(size, 2 * degree + 1)
        among = x[:done] @ x[:done].T
        np.fill_diagonal(among, -np.inf)
        seats = np.broadcast_to(np.arange(done), (done, done))
        near[:done] = diverse(x, np.where(np.isfinite(among), seats, -1), among, degree)
        width = max(width, degree)
        while done < size:
            batch = np.arange(done, min(size, 2 * done))
            linked, ready = near[:done], np.empty((len(batch), degree), np.int32)
            for part in range(0, len(batch), BATCH):
                some = batch[part:part + BATCH]
                asked = x[some]
                found, value = walk(x, linked, asked, self.entry(asked, done), width)
                among = asked @ x[batch].T
                among[np.arange(len(some)), some - done] = -np.inf
                side, beside = nearest(np.broadcast_to(batch, among.shape), among, width)
                side = np.where(beside > -np.inf, side, -1)
                ready[part:part + BATCH] = diverse(x, *nearest(np.hstack([found, side]), np.hstack([value, beside]), width), degree)
            near[batch] = ready
            self.link_back(x, near, batch, degree)
            done += len(batch)
        return near

    def link_back(self, x: np.ndarray, near: np.ndarray, batch: np.ndarray, degree: int) -> None:
        """Add the batch to its neighbours' lists; lists that overflow are chosen anew, among the nearest."""
        to, source = near[batch].ravel(), np.repeat(batch, degree)
        source, to = source[to >= 0], to[to >= 0]
        order = np.argsort(to, kind="stable")
        source, to = source[order], to[order]
        nodes, starts, counts = np.unique(to, return_index=True, return_counts=True)
        by_count = np.argsort(counts, kind="stable")
        nodes, starts, counts = nodes[by_count], starts[by_count], counts[by_count]
        part = 0
        while part < len(nodes):
            # Lists of like length go together, in blocks of bounded size.
            most = max(1, min(BATCH, 4 * BATCH * degree // (degree + int(counts[min(part + BATCH, len(nodes)) - 1]))))
            some, start, count = (a[part:part + most] for a in (nodes, starts, counts))
            row = np.repeat(np.arange(len(some)), count)
            place = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
            wide = np.full((len(some), int(count.max())), -1)
            wide[row, place] = source[np.repeat(start, count) + place]
            both = np.sort(np.hstack([near[some], wide]), axis=1)
            both[:, 1:][both[:, 1:] == both[:, :-1]] = -1
            value = np.where(both >= 0, np.einsum("qd,qed->qe", x[some], x[both]), -np.inf)
            near[some] = diverse(x, *nearest(both, value, 2 * degree), degree)
            part += len(some)

    def entry(self, asked: np.ndarray, upto: int) -> np.ndarray:
        """Where to enter the layer below those of at most `upto` nodes: the best nodes of the layers above. Several,
        as vectors of one dense group are linked to each other only, and one node may be in the wrong group."""
        at = np.zeros((len(asked), 1), int)
        for near in self.near:
            x = self.x[:len(near)]
            if len(near) <= min(upto, SEEN_WHOLE):
                similar = asked @ x.T
                at = nearest(np.broadcast_to(np.arange(len(x)), similar.shape), similar, ENTRIES)[0]
            elif len(near) <= upto:
                at = walk(x, near, asked, at, ENTRIES)[0]
        return at

    def search(self, asked: np.ndarray, width: int = SEARCH_WIDTH) -> tuple[np.ndarray, np.ndarray]:
        """Positions of the best nodes met in the lowest layer (-1: none) and their similarities; a graph that is
        no larger than the width is met whole."""
        if len(self.x) <= width:
            return np.broadcast_to(np.arange(len(self.x)), (len(asked), len(self.x))), asked @ self.x.T
        upper = len(self.near[-2]) if len(self.near) > 1 else 0
        out = []
        for part in range(0, len(asked), BATCH):
            some = asked[part:part + BATCH]
            out.append(walk(self.x, self.near[-1], some, self.entry(some, upper), width))
        return tuple(np.vstack(column) for column in zip(*out))


INDEX = "shard int, dim int, ids binary, nodes binary, vectors binary, sizes array<int>, degrees array<int>, neighbours binary"


def build_index(vectors: DataFrame, shards: int, parts: int) -> DataFrame:
    """One row per graph (INDEX); nodes gives the node of each id. A shard has `parts` graphs of each norm class."""

    def build(part: pd.DataFrame) -> pd.DataFrame:
        v = np.stack(part["v"].to_list())
        distinct, first, node = np.unique(v, axis=0, return_index=True, return_inverse=True)
        ids = part["vec_id"].to_numpy()
        index, order = Index.build(levelled(distinct.astype(np.float64)), layers_of(ids[first], DEGREE))
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        return pd.DataFrame({
            "shard": [int(part["shard"].iloc[0])], "dim": [v.shape[1]], "ids": [ids.tobytes()],
            "nodes": [place[node.ravel()].astype(np.int32).tobytes()], "vectors": [distinct[order].tobytes()],
            "sizes": [[len(n) for n in index.near]], "degrees": [[n.shape[1] for n in index.near]],
            "neighbours": [b"".join(n.astype(np.int32).tobytes() for n in index.near)]})

    hashed = F.xxhash64("vec_id")
    dealt = vectors.withColumn("shard", F.pmod(hashed, F.lit(shards)).cast("int")).withColumn(
        "part", F.pmod(F.xxhash64(hashed), F.lit(parts)).cast("int")).withColumn("norm_class", norm_class())
    return dealt.groupBy("shard", "dim", "norm_class", "part").applyInPandas(build, INDEX)


Found = tuple[np.ndarray, np.ndarray, np.ndarray]


def best(found: list[Found], k: int) -> Found:
    """The k best (query, id, score) of each query, by score, then smaller id."""
    queries, ids, scores = (np.concatenate(column) for column in zip(*found))
    order = np.lexsort((ids, -scores, queries))
    queries, ids, scores = queries[order], ids[order], scores[order]
    keep = np.arange(len(queries)) - np.searchsorted(queries, queries, side="left") < k
    return queries[keep], ids[keep], scores[keep]


def search_graph(row: pd.Series, asked_ids: np.ndarray, asked: np.ndarray, k: int) -> Found:
    """(query, id, score) of the k best candidates found in one graph."""
    ids = np.frombuffer(row["ids"], np.int64)
    nodes = np.frombuffer(row["nodes"], np.int32)
    dim, count = int(row["dim"]), int(row["sizes"][-1])
    real = np.float32 if len(row["vectors"]) == 4 * count * dim else np.float64
    vectors = np.frombuffer(row["vectors"], real).reshape(count, dim).astype(np.float64)
    flat, near, at = np.frombuffer(row["neighbours"], np.int32), [], 0
    for size, degree in zip(row["sizes"], row["degrees"]):
        near.append(flat[at:at + size * degree].reshape(size, degree))
        at += size * degree
    scaled = vectors / np.abs(vectors).max()
    index = Index((scaled / np.sqrt((scaled * scaled).sum(axis=1).max())).astype(np.float32), near)
    unit = asked / np.abs(asked).max(axis=1, keepdims=True)
    unit = (unit / np.sqrt((unit * unit).sum(axis=1, keepdims=True))).astype(np.float32)
    by_node = np.lexsort((ids, nodes))
    sorted_ids = ids[by_node]
    starts = np.searchsorted(nodes[by_node], np.arange(count + 1))
    # k + 1 ids of a node are enough: one of them may be the query's own.
    counts = np.minimum(np.diff(starts), k + 1)
    rounding = 2 * (dim + 4) * np.finfo(np.float32).eps
    found = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
    for part in range(0, len(asked), BATCH):
        some = slice(part, part + BATCH)
        met, similar = index.search(unit[some], max(SEARCH_WIDTH, 4 * k))
        real = met >= 0
        if met.shape[1] > k + 1:
            # Nodes that may tie with the last one stay, as any of their ids may be the smaller.
            real &= similar >= np.partition(similar, -k - 1, axis=1)[:, -k - 1, None] - rounding
        query, place = np.nonzero(real)
        query, node = np.divmod(np.unique(query * count + met[query, place]), count)
        scores = np.einsum("nd,nd->n", vectors[node], asked[some][query])
        each = counts[node]
        members = sorted_ids[np.repeat(starts[node] - np.cumsum(each) + each, each) + np.arange(each.sum())]
        query = np.repeat(asked_ids[some][query], each)
        other = members != query
        found.append(best([(query[other], members[other], np.repeat(scores, each)[other])], k))
    return tuple(np.concatenate(column) for column in zip(*found))


def divided(rows: int, held: int, asking: int, shard_bytes: int = SHARD_BYTES, graph: int = GRAPH) -> tuple[int, int, int]:
    """Shards, graphs of each norm class in a shard, and blocks of queries, from the rows and the bytes held and asking."""
    shards = max(LEAST_SHARDS, -(-held // shard_bytes))
    return shards, max(1, -(-rows // (shards * graph))), max(1, -(-asking // QUERY_BYTES))


def search(table: DataFrame, every: int, k: int, shard_bytes: int = SHARD_BYTES, graph: int = GRAPH) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found of each row whose vec_id divides by `every`."""
    vectors = staged(usable_vectors(table).withColumn("dim", F.size("v")), "hnsw-vectors")
    asking = F.pmod("vec_id", F.lit(every)) == 0
    component_bytes = 4 if vectors.schema["v"].dataType.elementType == FloatType() else 8
    row_bytes = component_bytes * F.col("dim").cast("long") + 4 * 2 * DEGREE
    sizes = vectors.agg(
        F.count("*").alias("n"), F.sum(row_bytes).alias("bytes"), F.sum(F.when(asking, row_bytes)).alias("asking")).first()
    shards, parts, query_blocks = divided(sizes["n"], sizes["bytes"] or 0, sizes["asking"] or 0, shard_bytes, graph)
    index = staged(build_index(vectors, shards, parts), "hnsw-index")
    all_of = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    index = index.withColumn("of_queries", all_of(query_blocks))
    queries = (vectors.where(asking).withColumn("of_queries", F.pmod(F.xxhash64("vec_id"), F.lit(query_blocks)).cast("int"))
               .withColumn("shard", all_of(shards)))
    keys = ["dim", "shard", "of_queries"]

    def run(asked: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
        found = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        if len(asked) and len(held):
            own = np.stack(asked["v"].to_list()).astype(np.float64)
            for _, row in held.iterrows():
                found = best([found, search_graph(row, asked["vec_id"].to_numpy(), own, k)], k)
        return pd.DataFrame(dict(zip(("query_id", "vec_id", "score"), found)))

    partial = queries.groupBy(*keys).cogroup(index.groupBy(*keys)).applyInPandas(run, "query_id long, vec_id long, score double")
    nearest = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return partial.withColumn("rank", F.row_number().over(nearest)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
