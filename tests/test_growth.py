"""Steps whose work must not grow with copies: equal vectors, shared names, words that nobody asks for."""

import itertools
import math
import random
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from palimpsest.operators import evalkit, expand, graph, ingest, lexical, neargraph, nested, postings, vector


def brute(queries, facts, k, other_only=False, text=False, least=None):
    out = set()
    for q, x in queries:
        s = [(-round(float(np.dot(x, y)), 9), str(e) if text else e, e) for e, y in facts if not (other_only and e == q)]
        out |= {(q, e, -score, i + 1) for i, (score, _, e) in enumerate(sorted(s)[:k]) if least is None or -score >= least}
    return out


@pytest.mark.parametrize("block", [7, 1000])
@pytest.mark.parametrize("other_only,text,least", [(False, False, None), (True, False, 0.2), (False, True, None), (True, False, None)])
def test_nearest_with_copies(spark, monkeypatch, block, other_only, text, least):
    monkeypatch.setattr(vector, "BLOCK", block)
    monkeypatch.setattr(vector, "PIECE", 9)
    r = np.random.default_rng(5)
    base = r.normal(size=(12, 4)).round(2)
    rows = [(i, [float(v) for v in base[i % 12 if i < 36 else i % 2]]) for i in range(60)]
    df = spark.createDataFrame(rows, "edge_id long, vector array<double>").repartition(3)
    ties = F.col("edge_id").cast("string") if text else None
    got = vector.nearest(df.withColumnRenamed("edge_id", "query_id"), df, 5, other_only, ties=ties, least=least).collect()
    want = brute(rows, rows, 5, other_only, text, least)
    assert {(x.query_id, x.edge_id, round(x.score, 9) + 0.0, x["rank"]) for x in got} == {(a, b, c + 0.0, d) for a, b, c, d in want}


def test_nearest_ranks_facts_of_one_vector_once(spark, monkeypatch):
    monkeypatch.setattr(vector, "BLOCK", 10)
    met = []
    blocks = vector._blocks
    monkeypatch.setattr(vector, "_blocks", lambda q, v, *a: met.append((q.count(), v.count())) or blocks(q, v, *a))
    df = spark.range(500).select(F.col("id").alias("edge_id"), F.array(F.lit(1.0), F.lit(0.0)).alias("vector"))
    got = vector.nearest(df.withColumnRenamed("edge_id", "query_id"), df, 3)
    assert got.count() == 1500 and {r.edge_id for r in got.collect()} == {0, 1, 2}
    assert met == [(1, 3)]


def test_resolve_with_names_that_many_nodes_share(spark):
    nodes = spark.range(400).select(F.col("id").alias("node"), F.lit("g").alias("group_id"), F.concat(F.lit("Name "), F.col("id") % 2).alias("name"), F.array(F.lit("one alias")).alias("aliases"), F.array(F.lit(0.0), F.lit(1.0)).alias("vector"))
    said = [(1, "NAME 1", [1.0, 0.0]), (2, "One Alias", [1.0, 0.0]), (3, "else", [1.0, 0.0]), (4, "other", [0.0, 1.0]), (5, "unname 0", [1.0, 0.0]), (6, "nobody", None)]
    mentions = spark.createDataFrame([(i, "g", n, v) for i, n, v in said], "mention_id long, group_id string, name string, vector array<double>")
    got = {r.mention_id: (r.decision, r.node) for r in ingest.resolve(mentions, nodes).collect()}
    assert got == {1: ("exact", 1), 2: ("alias", 0), 3: ("new", None), 4: ("ambiguous", 0), 5: ("ambiguous", 0), 6: ("new", None)}


def test_words_that_nobody_asks_for_stay_in_their_task(spark):
    facts = spark.createDataFrame([("g", 1, "red fox fox and a hill"), ("g", 2, "blue hill"), ("g", 3, None), ("h", 4, "fox")], "group_id string, edge_id long, fact string")
    asked = spark.createDataFrame([(1, "fox hill")], "query_id long, text string")
    rows = lexical.asked_words(facts, lexical.query_terms(asked)).collect()
    assert sorted((r.edge_id, r.token) for r in rows) == [(1, ""), (1, "fox"), (1, "fox"), (1, "hill"), (2, ""), (2, "hill"), (3, ""), (4, ""), (4, "fox")]
    stats = {"g": (3, 3.0), "h": (1, 1.0)}
    tf = {1: {"fox": 2, "hill": 1}, 2: {"hill": 1}, 4: {"fox": 1}}
    df, dl, of = {("g", "fox"): 1, ("g", "hill"): 2, ("h", "fox"): 1}, {1: 4, 2: 2, 4: 1}, {1: "g", 2: "g", 4: "h"}
    want = {e: round(sum(math.log(1 + (stats[of[e]][0] - df[of[e], t] + 0.5) / (df[of[e], t] + 0.5)) * n * 2.2 / (n + 1.2 * (0.25 + 0.75 * dl[e] / stats[of[e]][1])) for t, n in w.items()), 6) for e, w in tf.items()}
    assert {r.edge_id: round(r.score, 6) for r in lexical.bm25_scores(asked, facts).collect()} == want


def test_an_index_parts_its_texts_twice(spark):
    """Once for the lists, once for the lengths; statistics and searches read what was written."""
    facts = spark.createDataFrame([("g", i, f"word{i % 5} other") for i in range(200)], "group_id string, edge_id long, fact string")
    index = postings.append(postings.keep(facts.where("edge_id < 150")), facts.where("edge_id >= 150"))
    for table in (index.postings, index.docs, index.terms, index.scopes, postings.refresh(index).terms):
        assert "Scan ExistingRDD" not in table._jdf.queryExecution().executedPlan().toString()
    asked = spark.createDataFrame([(1, "word3")], "query_id long, text string")
    assert [r.edge_id for r in postings.search(index, asked, 3).orderBy("rank").collect()] == [3, 8, 13]


def test_facts_of_prefixes_stay_in_their_tasks(spark):
    """Every third key is shared by two facts; a prefix may end between them."""
    facts = spark.range(400).select(F.col("id").alias("edge_id"), (F.col("id") * 7 % 300).alias("at"), F.lit("word").alias("fact")).repartition(4, "edge_id")
    found, sizes = nested.placed(facts, ["at"])
    assert sizes == [400, 200, 100, 50, 25] and set(found.columns) == {"edge_id", "at", "fact", "levels"}
    order = sorted(range(400), key=lambda i: (i * 7 % 300, i))
    assert {r.edge_id: r.levels for r in found.collect()} == {i: sum(place < n for n in sizes) for place, i in enumerate(order)}
    assert max(r["count"] for r in found.groupBy(F.spark_partition_id()).count().collect()) < 200
    few, none = nested.placed(facts.limit(10), ["at"])
    assert few.collect() == [] and none == []


def test_labels_that_swap_for_ever_are_not_spread_to_the_end(spark, monkeypatch):
    """Two nodes swap their labels, a path settles: rounds end when all is as two rounds before; the labels of the last one are known then."""
    made = []
    for name in ("cut", "written"):
        f = getattr(graph, name)
        monkeypatch.setattr(graph, name, lambda *args, f=f: made.append(args) or f(*args))
    nodes = spark.createDataFrame([(i, "") for i in (1, 2, 5, 6, 7, 9)], "node bigint, name string")
    edges = spark.createDataFrame([(1, 2), (5, 6), (6, 7), (7, 7)], "start_id bigint, end_id bigint")
    for rounds, swapped in ((40, False), (41, True), (2, False), (1, True)):
        made.clear()
        got = {r.node: r.label for r in graph.spread_labels(nodes, edges, rounds).collect()}
        label = {n: n for n in (1, 2, 5, 6, 7, 9)}
        for _ in range(rounds):
            label = {1: label[2], 2: label[1], 5: label[6], 6: min(label[5], label[7]), 7: label[6], 9: 9}
        assert got == label and (got[1] == 2) == swapped
        assert len(made) < 10


@pytest.mark.parametrize("k", [2, 5, 500])
def test_hops_from_nodes_that_many_edges_share(spark, k):
    """Few nodes, hundreds of edges, some ids twice, an end missing, loops; seeds are among the first edges of their nodes."""
    r = random.Random(k)
    edges = [(i % 280, r.choice([1, 2, 3, None]), r.choice([3, 11, 12, 13, 14]), "led_to" if i % 9 == 0 else None) for i in range(300)] + [(900, 20, 20, "led_to"), (901, 1, 20, None), (902, 20, 21, "led_to"), (903, 21, 22, None)]
    seeds = [(7, e, n + 1) for n, e in enumerate((0, 1, 4, 5))] + [(8, 901, 1), (9, 902, 1), (10, 12345, 1)]
    of = lambda rows: [(e, n) for e, a, b, _ in rows for n in {a, b} - {None}]
    ends, hinted = of(edges), of([e for e in edges if e[3]])
    structural, authored = set(), set()
    for q in (7, 8, 9, 10):
        own = {e: n for s, e, n in seeds if s == q}
        least = lambda pairs: {x: min(n for y, n in pairs if y == x) for x, _ in pairs}
        touched = least([(v, own[e]) for e, v in ends if e in own])
        near = least([(e, touched[v]) for e, v in ends if v in touched])
        one = least([(e, touched[v]) for e, v in hinted if v in touched])
        far = least([(v, one[e]) for e, v in hinted if e in one and v not in touched])
        two = least([(e, far[v]) for e, v in ends if v in far])
        best = {e: (2, n) for e, n in two.items()} | {e: (1, n) for e, n in one.items()}
        structural |= {(q, e, n, i + 1) for i, (n, e) in enumerate(sorted((n, e) for e, n in near.items() if e not in own)[:k])}
        authored |= {(q, e, *n, i + 1) for i, (n, e) in enumerate(sorted((n, e) for e, n in best.items() if e not in own)[:k])}
    asked, df = spark.createDataFrame(seeds, "query_id long, edge_id long, rank int"), spark.createDataFrame(edges, "edge_id long, start_id long, end_id long, causal_hint string")
    assert {(x.query_id, x.edge_id, x.seed_rank, x["rank"]) for x in expand.structural_hop(asked, df, k).collect()} == structural
    assert {(x.query_id, x.edge_id, x.tier, x.seed_rank, x["rank"]) for x in expand.authored_hop(asked, df, k).collect()} == authored
    given = expand._first_ends(df, k + 4).groupBy("node").count().collect()
    assert max(x["count"] for x in given) <= k + 4 and {x.node for x in given if x.node is not None} == {n for _, n in ends}


def test_triangles_are_sought_only_where_first_pairs_leave_cases_open(spark, monkeypatch):
    """Parts and suppliers have no triangle; then a clique, with a node that has only one open pair far behind its first ones."""
    linked = []
    triangles = evalkit.triangles
    monkeypatch.setattr(evalkit, "triangles", lambda links: linked.append(links.count()) or triangles(links))
    r = random.Random(3)
    parts = [(n, a, 100 + b) for n, (a, b) in enumerate(sorted({(r.randrange(40), r.randrange(9)) for _ in range(200)}))]
    clique = [(1000 + n, a, b) for n, (a, b) in enumerate(itertools.combinations(range(500, 516), 2))] + [(5000, 500, 600), (5001, 600, 101)]
    for edges in (parts, parts + clique):
        linked.clear()
        near, want = {frozenset(e[1:]) for e in edges}, []
        for hub in {n for e in edges for n in e[1:]}:
            arms = sorted((e, b if a == hub else a) for e, a, b in edges if hub in (a, b))
            want += [(hub, x[0], y[0]) for x, y in itertools.combinations(arms, 2) if x[1] != y[1] and frozenset((x[1], y[1])) not in near][:6]
        got = evalkit.multihop_cases(spark.createDataFrame(edges, "edge_id long, start_id long, end_id long")).collect()
        assert sorted((x.hub, x.a, x.b) for x in got) == sorted(want)
        assert len(linked) == (edges is not parts) and sum(linked) <= len(clique)


def test_a_shard_is_made_and_walked_in_bounded_blocks():
    """A full shard of 20,000 vectors, a batch of 10,000 rows and 1,024 pivots; the links are those of whole blocks."""
    r = np.random.default_rng(1)
    x = r.normal(size=(neargraph.SHARD, 8))
    tracemalloc.start()
    try:
        links, near = neargraph.graph(x), neargraph.members(x)
        assert tracemalloc.get_traced_memory()[1] < 60e6
        tracemalloc.reset_peak()
        batch = pa.record_batch({"query_id": pa.array(range(10_000)), "vector": pa.array(x[:10_000].tolist())})
        (out,) = neargraph._best_pivots(x[:1_024], 1)([batch])
        assert tracemalloc.get_traced_memory()[1] < 60e6
    finally:
        tracemalloc.stop()
    assert [v[0] for v in out.column("pivots").to_pylist()] == (x[:10_000] @ x[:1_024].T).argmax(1).tolist()
    for i in (0, 7_777, 19_999):
        order = [j for j in np.argsort(-(x @ x[i]), kind="stable")[:60] if j != i]
        assert links[i, 0] == order[0]
    assert sorted(near[near >= 0].tolist()) == sorted(set(near[near >= 0].tolist()))


def test_a_kept_index_is_made_once(spark):
    vectors = spark.range(50).select(F.col("id").alias("edge_id"), F.array(F.col("id").cast("double"), F.lit(1.0)).alias("vector"))
    index = neargraph.build(vectors, shard=20)
    assert "FlatMapGroupsInArrow" not in index.shards._jdf.queryExecution().executedPlan().toString()
    got = neargraph.search(index, vectors.where("edge_id = 3").withColumnRenamed("edge_id", "query_id"), 2).orderBy("rank").collect()
    assert [x.edge_id for x in got] == [49, 48]


def test_names_that_many_nodes_share_are_dealt(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(graph, "PAIRED", 100, raising=False)  # there was no such constant before
    n = F.col("id")
    nodes = spark.range(1000).select(n.alias("node"), F.lit("g").alias("group_id"), F.lit("Red Bolt").alias("name"), F.array(F.lit("red bolt")).alias("aliases"))
    got = graph.foreign_aliases(nodes).select("*", F.spark_partition_id().alias("task"))
    by_task = {r.task: r["count"] for r in got.groupBy("task").count().collect()}
    assert sum(by_task.values()) == 1000 * 999 and len(by_task) > 1
    assert got.groupBy("node").agg(F.count_distinct("other").alias("others")).where("others = 999").count() == 1000
    got.drop("task").write.parquet(str(tmp_path / "out"))
    assert sum(p.stat().st_size for p in (tmp_path / "out").glob("*.parquet")) < 1000 * 999 / 2


@pytest.mark.parametrize("paired,run", [(2, 2), (3, 1), (4096, 256)])
def test_foreign_aliases_by_brute_force(spark, monkeypatch, paired, run):
    monkeypatch.setattr(graph, "PAIRED", paired, raising=False)
    monkeypatch.setattr(graph, "RUN", run, raising=False)
    rows = [(i, "gh"[i % 5 == 0], ["Ox", "oX", "Elk", None, "eel"][i % 7 % 5], [["OX", "ox", "ox", "elk"], ["none", None], [], None, ["Eel"]][i % 11 % 5]) for i in range(40)]
    rows += [(None, "g", "ox", ["ox"]), (50, None, "ox", ["ox"]), (51, "g", "Sole", ["ox", "lone"]), (52, "g", "LONE", [])]
    nodes = spark.createDataFrame(rows, "node long, group_id string, name string, aliases array<string>").repartition(3)
    want = [(g, n, a, o) for n, g, _, aliases in rows for a in aliases or [] for o, h, name, _ in rows if None not in (n, g, a, o, h, name) and g == h and name.lower() == a.lower() and n != o]
    assert sorted(map(tuple, graph.foreign_aliases(nodes).collect())) == sorted(want)
