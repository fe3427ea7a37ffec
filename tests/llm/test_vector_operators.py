"""Cover tree search against brute force; graph search by recall."""

import math

import numpy as np
import pandas as pd
import pytest

from metrospect.llm import cover_tree, hnsw

SCHEMA = "vec_id long, embedding array<float>, label int, score string, v string"


def table(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], 1, "a", "b") for i, v in rows], SCHEMA)


def clustered(n, dim, seed=1):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, dim))
    x[n // 2:] = x[:5][rng.integers(0, 5, n - n // 2)] + rng.normal(size=(n - n // 2, dim)) * 0.02
    x[-n // 10:] = x[3]
    return x / np.linalg.norm(x, axis=1, keepdims=True)


ODD = [
    (None, [1, 0, 0]), (90_000, None), (90_100, []), (90_200, [1, None, 0]), (90_300, [math.nan, 0, 0]), (90_400, [math.inf, 0, 0]),
]


@pytest.mark.parametrize("block_bytes", [16 << 20, 4_000])
def test_cover_tree_is_exact(spark, block_bytes):
    x = clustered(600, 12).astype(np.float32)
    rows = list(enumerate(x.tolist())) + ODD + [(700, [1, 2, 3]), (800, [2, 2, 2]), (5, x[5].tolist())]
    got = {}
    for r in cover_tree.top_k(table(spark, rows), 100, 10, block_bytes=block_bytes).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    whole = np.floor(x.astype(np.float64) * 1024).astype(np.int64)
    assert set(got) == {0, 100, 200, 300, 400, 500, 700, 800}
    for q in range(0, 600, 100):
        scores = whole @ whole[q]
        order = [i for i in np.lexsort((np.arange(600), -scores)) if i != q][:10]
        assert sorted(got[q]) == [(k + 1, i, scores[i]) for k, i in enumerate(order)]
    assert sorted(got[700]) == [(1, 800, 12 * 1024 * 1024)]


def test_pairs_are_pruned(monkeypatch):
    x = np.floor(clustered(4000, 6) * 1024)
    met = []
    search = cover_tree.Search(x[::100], np.arange(4000)[::100], x, np.arange(4000), 3)
    real = search.meet
    monkeypatch.setattr(search, "meet", lambda a, b: (met.append(len(a) * len(b)), real(a, b)))
    search.run()
    assert sum(met) < 0.7 * 40 * 4000


def test_large_components_stay_exact(spark):
    """Scores beyond 2^53, many of them one apart, where doubles would lose order and ties."""
    rng = np.random.default_rng(3)
    rows = [(i, [2**28 + int(a), 2**28 + int(b), 1 + i % 3]) for i, (a, b) in enumerate(rng.integers(0, 3, (400, 2)))]
    got = {}
    for r in cover_tree.top_k(table(spark, rows), 100, 10, scale=1).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    # Floats hold these components only roughly, so the whole numbers are those that the table holds.
    whole = {i: [int(np.float32(x)) for x in v] for i, v in rows}
    for q in range(0, 400, 100):
        scored = sorted((-sum(x * y for x, y in zip(whole[q], v)), i) for i, v in whole.items() if i != q)[:10]
        assert sorted(got[q]) == [(k + 1, i, -s) for k, (s, i) in enumerate(scored)]
        assert -scored[0][0] > 2**53


def test_exact_search_of_large_whole_numbers():
    rng = np.random.default_rng(5)
    d = 2**30 + rng.integers(0, 2, (500, 2))
    q, ids = d[:5] + 1, np.arange(500)
    search = cover_tree.Search(q, ids[:5], d, ids, 7)
    search.run()
    for i in range(5):
        scored = sorted((-sum(int(x) * int(y) for x, y in zip(q[i], d[j])), j) for j in range(500) if j != i)[:7]
        assert list(zip(search.scores[i].tolist(), search.found[i].tolist())) == [(-s, j) for s, j in scored]
    assert len({int(s) for s in search.scores.ravel()}) > 1 and min(search.scores.ravel()) > 2**53


def test_graph_recall(spark):
    x = clustered(3000, 16, 4).astype(np.float32).astype(np.float64)
    rows = list(enumerate(x.tolist())) + ODD + [(5000, [0.0] * 16), (6000, [1, 2, 3])]
    got = {}
    for r in hnsw.search(table(spark, rows), 20, 20).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    hit = total = 0
    for q in range(0, 3000, 20):
        scores = x @ x[q]
        scores[q] = -np.inf
        want = set(np.lexsort((np.arange(3000), -scores))[:20].tolist())
        mine = sorted(got[q])
        assert [m[0] for m in mine] == list(range(1, 21)) and q not in {m[1] for m in mine}
        assert [(-m[2], m[1]) for m in mine] == sorted((-m[2], m[1]) for m in mine)
        assert all(m[2] == pytest.approx(scores[m[1]], abs=1e-12) for m in mine)
        tied = {i for i in range(3000) if scores[i] >= min(scores[j] for j in want) - 1e-9}
        hit += len(tied & {m[1] for m in mine})
        total += 20
    assert hit / total >= 0.95
    assert 5000 not in got and 6000 not in got


def test_ties_go_to_the_smaller_id(spark):
    rows = [(500, [2, 0])] + [(71 + t, [1, t]) for t in range(30)] + [(0, [1, 0])]
    got = sorted((r.query_id, r.rank, r.vec_id) for r in hnsw.search(table(spark, rows), 1000, 2).collect())
    assert got == [(0, 1, 500), (0, 2, 71)]


def one_graph_recall(x, asked=60, k=20):
    """The share of the true k nearest that one graph of all rows finds."""
    v = np.asarray(x, np.float64)
    part = pd.DataFrame({"ids": [np.arange(len(v)).tobytes()]})
    index, order = hnsw.Index.build(hnsw.levelled(v), hnsw.layers_of(np.arange(len(v)), hnsw.DEGREE))
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    part["nodes"] = [place.astype(np.int32).tobytes()]
    part["vectors"] = [v[order].tobytes()]
    part["dim"] = v.shape[1]
    part["sizes"], part["degrees"] = [[len(n) for n in index.near]], [[n.shape[1] for n in index.near]]
    part["neighbours"] = [b"".join(n.astype(np.int32).tobytes() for n in index.near)]
    queries, ids, scores = hnsw.search_graph(part.iloc[0], np.arange(asked), v[:asked], k)
    hit = 0
    for q in range(asked):
        true = v @ v[q]
        true[q] = -np.inf
        hit += (scores[queries == q] >= np.sort(true)[-k] - 1e-9 * abs(true).max(where=np.isfinite(true), initial=1.0)).sum()
    return hit / asked / k


def test_recall_of_a_whole_graph():
    """The hard case: all neighbours in one graph as large as they get."""
    x = np.random.default_rng(6).normal(size=(hnsw.GRAPH, 64))
    assert one_graph_recall(x) >= 0.9
    assert one_graph_recall(x / np.linalg.norm(x, axis=1, keepdims=True)) >= 0.9


def test_recall_where_norms_differ():
    """A few vectors twice as long as most: the nearest are not those of nearest direction alone."""
    rng = np.random.default_rng(8)
    x = rng.normal(size=(5_000, 64))
    x *= (1 + rng.uniform(size=(5_000, 1)) ** 8) / np.linalg.norm(x, axis=1, keepdims=True)
    assert one_graph_recall(x) >= 0.95


def test_a_walk_lists_a_node_once():
    x = np.random.default_rng(9).normal(size=(3_000, 16))
    index, _ = hnsw.Index.build(hnsw.levelled(x), hnsw.layers_of(np.arange(len(x)), hnsw.DEGREE))
    met, similar = index.search(index.x[:300], 64)
    assert met.shape == (300, 64)
    for query, (nodes, value) in enumerate(zip(met, similar)):
        assert nodes[0] == query and len(set(nodes.tolist()) - {-1}) == 64 and (np.diff(value) <= 0).all()


def test_few_graphs_at_size(spark):
    """Work grows with the number of graphs that a query meets."""
    shards, parts, blocks = hnsw.divided(615_000, 615_000 * (64 * 4 + 128), 30_750 * (64 * 4 + 128))
    assert shards * parts <= 16 and blocks == 1
    x = np.random.default_rng(10).normal(size=(400, 8))
    x = (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)
    vectors = hnsw.usable_vectors(table(spark, list(enumerate(x.tolist())))).selectExpr("*", "size(v) AS dim")
    assert hnsw.build_index(vectors, 1, 1).count() == 1


def test_scores_of_doubles_and_extreme_norms(spark):
    rows = [(0, [1 / 3, 0.1]), (1, [0.1, 1 / 3]), (2, [1e200, 1e200]), (3, [1e-200, 0.0])]
    docs = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = [(r.rank, r.vec_id, r.score) for r in hnsw.search(docs, 20, 20).orderBy("rank").collect()]
    assert [g[:2] for g in got] == [(1, 2), (2, 1), (3, 3)]
    assert [g[2] for g in got] == [pytest.approx(s, rel=1e-15) for s in (1e200 / 3 + 1e199, 0.2 / 3, 1e-200 / 3)]


def test_norms_far_apart(spark):
    """One long vector must not drown the others' products."""
    rng = np.random.default_rng(7)
    x = rng.normal(size=(2_000, 32))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    x[777] *= 1e9
    x[1_000:1_200] *= 1e-6
    x = x.astype(np.float32).astype(np.float64)
    got = {}
    for r in hnsw.search(table(spark, list(enumerate(x.tolist()))), 50, 10).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    hit = 0
    for q in range(0, 2_000, 50):
        true = x @ x[q]
        true[q] = -np.inf
        hit += len(got[q] & set(np.argsort(-true)[:10].tolist()))
    assert hit / 40 / 10 >= 0.97


def test_small_and_empty_tables(spark):
    few = [(0, [1, 0]), (20, [0, 1]), (21, [1, 1])]
    for found in (hnsw.search(table(spark, few), 20, 20), cover_tree.top_k(table(spark, few), 20, 20)):
        assert sorted((r.query_id, r.rank, r.vec_id) for r in found.collect()) == [(0, 1, 21), (0, 2, 20), (20, 1, 21), (20, 2, 0)]
    assert hnsw.search(table(spark, []), 20, 20).count() == 0
    assert cover_tree.top_k(table(spark, []), 100, 10).count() == 0
