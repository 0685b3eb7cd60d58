"""The graph of near vectors: recall against brute force, and what it costs."""

import numpy as np
import pytest

from palimpsest.operators import neargraph, vector


def clustered(n, d=32, seed=1, spread=0.25):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(max(4, n // 60), d))
    x = centres[rng.integers(len(centres), size=n)] + spread * rng.normal(size=(n, d))
    return x / np.linalg.norm(x, axis=1, keepdims=True)


@pytest.mark.parametrize("n, most", [(300, 1.0), (20_000, 0.05)])
def test_recall_and_work_of_a_shard(n, most):
    """All vectors are asked for; the products of the walk are a small part of all."""
    x = clustered(n)
    links, near = neargraph.graph(x), neargraph.members(x)
    asked = np.arange(0, n, max(1, n // 1500))
    hits, products = 0, 0
    for at in range(0, len(asked), 250):
        q = asked[at : at + 250]
        places, scores, done = neargraph.walk(x[q], x, links, near)
        assert (np.diff(scores, axis=1) <= 0).all()
        want = np.argsort(-(x[q] @ x.T), axis=1, kind="stable")[:, :10]
        hits += sum(len(set(a[:10]) & set(b)) for a, b in zip(places.tolist(), want.tolist()))
        products += done
    assert hits / (10 * len(asked)) >= 0.95 and products <= most * len(asked) * n


def test_copies_do_not_cut_the_graph():
    x = clustered(3000)
    x[:1500] = x[0]  # half of all are one vector
    places, scores, _ = neargraph.walk(x[2000:2100], x, neargraph.graph(x), neargraph.members(x))
    best = np.sort(x[2000:2100] @ x.T, axis=1)[:, ::-1][:, :10]
    assert (np.abs(scores[:, :10] - best) < 1e-9).mean() >= 0.95


def test_search_over_shards(spark):
    x = clustered(2500, 16)
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "edge_id long, vector array<double>").repartition(4)
    queries = rows.where("edge_id % 10 = 0").selectExpr("edge_id AS query_id", "vector")
    index = neargraph.build(rows, shard=400)
    assert len(index.pivots) == 7 and index.shards.agg({"n": "sum"}).first()[0] == 2500 and index.shards.agg({"n": "max"}).first()[0] < 700
    want = {(r.query_id, r.rank): r.score for r in vector.nearest(queries, rows, 10, other_only=True).collect()}
    for probe, least in ((None, 0.99), (3, 0.9)):
        got = neargraph.search(index, queries, 10, probe, other_only=True).collect()
        assert all(r.query_id != r.edge_id for r in got) and len(got) == len(want)
        assert sum(abs(want[r.query_id, r["rank"]] - r.score) < 1e-9 for r in got) >= least * len(want)


def test_search_of_nothing(spark):
    none = spark.createDataFrame([], "edge_id long, vector array<double>")
    one = spark.createDataFrame([(5, [1.0, 0.0])], "edge_id long, vector array<double>")
    asked = one.selectExpr("edge_id AS query_id", "vector")
    assert neargraph.search(neargraph.build(none), asked).collect() == []
    assert [(r.edge_id, r.score) for r in neargraph.search(neargraph.build(one), asked, 3).collect()] == [(5, 1.0)]
    assert neargraph.search(neargraph.build(one), asked, 3, other_only=True).collect() == []
