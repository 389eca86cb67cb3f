"""Small-world graphs: recall against brute force, reach, exact scores, odd rows."""

import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from almanac.llm import neighbours, queries
from almanac.llm.hnsw import Graph, Links
from almanac.llm.neighbours import Shards


def slow(rows, k=5, every=50):
    """{place of the query: its k nearest (score, id)} by brute force."""
    fine = [(i, np.array(v, dtype=float)) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    width = max((len(v) for _, v in fine), default=1)
    x = np.array([np.pad(v, (0, width - len(v))) for _, v in fine]).reshape(-1, width)
    x = x / np.linalg.norm(x, axis=1, keepdims=True)
    out = []
    for at, (i, _) in enumerate(fine):
        if i % every == 0:
            score = x @ x[at]
            best = sorted((-score[j], fine[j][0]) for j in range(len(fine)) if j != at)[:k]
            out.append((i, [(-s, j) for s, j in best]))
    return out


def recall(got, rows, k=5):
    """Share of the brute-force results that are found, where a score as high as the last counts as found."""
    by_query = {}
    for r in got:
        by_query.setdefault(r.query_id, []).append(r)
    hits = total = 0
    for i, best in slow(rows, k):
        found = by_query.get(i, [])
        assert [r["rank"] for r in found] == list(range(1, len(best) + 1))
        assert [(-round(r.score, 12), r.vec_id) for r in found] == sorted((-round(r.score, 12), r.vec_id) for r in found)
        total += len(best)
        hits += sum(r.score >= best[-1][0] - 1e-9 for r in found)
    return hits / max(total, 1)


@pytest.mark.parametrize("sf", ["sf0.01", "sf0.1"])
def test_query_recall_and_scores(spark, sf):
    d = f"/root/testdata/{sf}"
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{d}/embeddings.parquet").collect()]
    got = sorted(queries.op11_nearest_neighbours(spark, d).collect(), key=lambda r: (r.query_id, r["rank"]))
    assert recall(got, rows) >= 0.98
    v = {i: np.array(x, dtype=float) for i, x in rows}
    assert all(abs(r.score - v[r.query_id] @ v[r.vec_id] / (np.linalg.norm(v[r.query_id]) * np.linalg.norm(v[r.vec_id]))) < 1e-12 for r in got)


def clustered(n, d=24, centers=40, seed=4):
    rng = np.random.default_rng(seed)
    return (rng.normal(size=(centers, d))[rng.integers(0, centers, n)] + rng.normal(size=(n, d)) * 0.01).astype(np.float32)


def test_several_shards_and_blocks_on_clusters(spark):
    x = clustered(3000)
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(6)
    p = Shards(shards=4, least=100, most=700, queries=1, links=Links(batch=64))
    assert p.count(3000) == 5
    got = sorted(neighbours.nearest(df, every=3, p=p).collect(), key=lambda r: (r.query_id, r["rank"]))
    by_query = {}
    for r in got:
        by_query.setdefault(r.query_id, []).append(r.score)
    best = dict(slow(rows, every=3))
    assert all(len(s) == 5 for s in by_query.values()) and len(by_query) == 1000
    assert np.mean([np.mean([s >= best[q][-1][0] - 1e-9 for s in found]) for q, found in by_query.items()]) >= 0.95


@settings(max_examples=25, deadline=None)
@given(st.integers(0, 2**32), st.integers(1, 400), st.integers(2, 12), st.booleans())
def test_every_node_is_in_reach(seed, n, d, tight):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, d)) * (0.001 if tight else 1) + (rng.integers(0, 3, (n, 1)) * 5 if tight else 0)
    x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)
    graph, order = Graph.build(x.astype(np.float32), Links(links=4, build=12, search=12))
    assert sorted(order) == list(range(n))
    seen, edge = {0}, [0]
    while edge:
        edge = [j for i in edge for j in graph.layers[0][i].tolist() if j >= 0 and j not in seen and not seen.add(j)]
    assert len(seen) == n
    ids, sim = graph.search(x[:20].astype(np.float32), 5)
    assert ((ids >= 0).sum(axis=1) == min(5, n)).all()
    assert all(len({i for i in row if i >= 0}) == (row >= 0).sum() for row in ids)


def test_odd_rows(spark):
    """Nulls, zeros, infinities, ragged and huge vectors, rows that share an id or a vector, a hot vector, clashing columns."""
    hot = [1.0, 2.0, 0.5]
    rows = [(i, hot) for i in range(0, 400)] + [(50, [2.0, 4.0, 1.0]), (50, [1.0, 0.0, 0.0]), (100, None), (150, [0.0, 0.0]), (200, [1.0, None]), (250, [float("inf"), 1.0]), (None, hot)]
    rows += [(1000 + i, [math.cos(i), math.sin(i)]) for i in range(60)] + [(300, [1e30, 1e30, -1e30]), (350, [1e-30, 1e-30]), (3000, [])]
    df = spark.createDataFrame([(i, v, "x", 1) for i, v in rows], "vec_id long, embedding array<float>, shard string, score int").repartition(4)
    got = neighbours.nearest(df).collect()
    want = []
    for i, best in slow([(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v]) for i, v in rows]):
        want += [(i, n + 1, round(s, 9)) for n, (s, j) in enumerate(best)]
    assert sorted((r.query_id, r["rank"], round(r.score, 9)) for r in got) == sorted(want)
    assert [r.vec_id for r in sorted(got, key=lambda r: r["rank"]) if r.query_id == 0] == [1, 2, 3, 4, 5]


def test_few_and_no_rows(spark):
    two = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 1.0])], "vec_id long, embedding array<double>")
    assert [tuple(r) for r in neighbours.nearest(two).collect()] == [(0, 1, 1, 0.0)]
    assert neighbours.nearest(two.limit(0)).collect() == []
