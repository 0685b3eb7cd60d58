"""Kept postings, pieces of names, canonical intervals and triangles against brute force."""

import hashlib
import hmac
import itertools
import math
import random

import pytest
from pyspark.sql import functions as F

from palimpsest.operators import evalkit, expand, keychain, lexical, nested, postings, retrieve, temporal

WORDS = [f"w{k}" for k in range(60)]


def some_facts(n, seed=1, scopes="ab"):
    rng = random.Random(seed)
    return [(rng.choice(scopes), k * rng.choice([1, 1, 7]) + 10_000 * k, " ".join(rng.choices(WORDS, weights=[1 / (i + 1) for i in range(60)], k=rng.randrange(0, 25)))) for k in range(n)]


def some_queries(spark, n=12, seed=2):
    rng = random.Random(seed)
    return spark.createDataFrame([(q, " ".join(rng.sample(WORDS, 5)), rng.choice("ab")) for q in range(n)], "query_id long, text string, group_id string")


def table_of(spark, rows):
    return spark.createDataFrame(rows, "group_id string, edge_id long, fact string")


@pytest.mark.parametrize("width, probe, k", [(50_000, 2, 3), (300_000, 1, 5), (10_000, 4, 50)])
def test_pruned_search_is_bm25(spark, width, probe, k):
    facts = table_of(spark, some_facts(400))
    queries = some_queries(spark)
    index = postings.build(facts, width)
    for by_scope in (False, True):
        asked = queries if by_scope else queries.drop("group_id")
        want = lexical.bm25(asked, facts, k, by_scope)
        got = postings.search(index, asked, k, by_scope, probe=probe)
        columns = ["query_id", "group_id", "edge_id", "score", "rank"]
        assert sorted(map(tuple, got.select(*columns).collect())) == sorted(map(tuple, want.select(*columns).collect()))
    only = facts.where("edge_id % 3 = 0").select("edge_id")
    want = lexical.bm25(queries.drop("group_id"), facts, k, only=only)
    got = postings.search(index, queries.drop("group_id"), k, only=only, probe=probe)
    assert sorted(map(tuple, got.select(*columns).collect())) == sorted(map(tuple, want.select(*columns).collect()))


def test_blocks_are_left_out(spark):
    """A rare word in a few slots: most blocks of the frequent one are not read."""
    rows = [("a", k, "common " * (1 + k % 3) + "filler " * 20 + ("rare common " * 6 if k % 400 == 0 else "")) for k in range(4000)]
    index = postings.build(table_of(spark, rows), 100)
    asked = spark.createDataFrame([(1, "rare common")], "query_id long, text string")
    every, alive = postings.prune(index, asked, 3)
    assert alive.count() * 2 < every.count()
    assert [r.edge_id for r in postings.search(index, asked, 5).orderBy("rank").collect()] == [r.edge_id for r in lexical.bm25(asked, table_of(spark, rows), 5).orderBy("rank").collect()]


def test_a_kept_index_does_not_read_texts(spark, tmp_path):
    facts = table_of(spark, some_facts(200))
    facts.write.parquet(str(tmp_path / "facts"))
    postings.save(postings.build(spark.read.parquet(str(tmp_path / "facts"))), str(tmp_path / "index"))
    index = postings.load(spark, str(tmp_path / "index"))
    found = retrieve.query_memory(some_queries(spark).drop("group_id"), spark.read.parquet(str(tmp_path / "facts")), retrieve.Options(lexical_only=True), index=index)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert str(tmp_path / "facts") not in plan and "fact#" not in plan
    want = retrieve.query_memory(some_queries(spark).drop("group_id"), facts, retrieve.Options(lexical_only=True))
    assert sorted(map(str, found.collect())) == sorted(map(str, want.collect()))


def test_rare_words_unseen_words_and_ties(spark):
    rows = [("a", k, f"project note {'zebra' if k == 77 else 'plain'} number{k}") for k in range(120)]
    index = postings.build(table_of(spark, rows))
    ask = lambda i, t: [r.edge_id for r in postings.search(i, spark.createDataFrame([(1, t)], "query_id long, text string"), 3).orderBy("rank").collect()]
    assert ask(index, "zebra project")[0] == 77 and ask(index, "project note") == [0, 1, 2] and ask(index, "nothing here") == [] and ask(index, "") == []
    more = postings.append(index, table_of(spark, [("a", 500, "project note quagga"), ("a", 501, "project note plain")]))
    assert ask(more, "quagga project")[0] == 500  # not in the statistics: the rarest word there is
    refreshed = postings.refresh(more)
    assert refreshed.terms.where("token = 'quagga'").first().df == 1 and refreshed.scopes.first().n_docs == 122


def test_statistics_become_stale_and_are_made_anew(spark):
    rows = lambda scope, lo, hi: [(scope, k, f"word{k % 9} text here") for k in range(lo, hi)]
    index = postings.build(table_of(spark, rows("large", 0, 100) + rows("small", 1000, 1020)))
    state = lambda i: {r.group_id: (r.refreshed_docs, r.writes_since, r.usable) for r in postings.staleness(i).collect()}
    assert state(index) == {"large": (100, 0, True), "small": (20, 0, False)}
    grown = postings.append(index, table_of(spark, rows("large", 200, 220)))
    assert state(grown)["large"] == (100, 20, True)
    grown = postings.append(grown, table_of(spark, rows("large", 300, 301) + rows("new", 5000, 5070)))
    assert state(grown) == {"large": (100, 21, False), "small": (20, 0, False), "new": (0, 70, False)}
    asked = spark.createDataFrame([(1, "word3 text", "large"), (2, "word3 text", "small"), (3, "word3", "unknown")], "query_id long, text string, group_id string")
    assert {(r.query_id, r.ranker) for r in postings.lexical_channel(grown, asked, by_scope=True).collect()} == {(1, "matches"), (2, "matches")}
    anew = postings.refresh_if_due(grown)
    assert state(anew) == {"large": (121, 0, True), "small": (20, 0, False), "new": (70, 0, True)}
    assert {(r.query_id, r.ranker) for r in postings.lexical_channel(anew, asked, by_scope=True).collect()} == {(1, "bm25"), (2, "matches")}
    assert postings.lexical_channel(postings.build(table_of(spark, [])), asked, by_scope=True).collect() == []


def test_names_holding_by_brute_force(spark):
    rng = random.Random(3)
    names = ["".join(rng.choices("abcé🙂 ", k=rng.randrange(0, 12))) for _ in range(150)] + ["x" * 50_000, "needle" + "y" * 70_000 + "end"]
    terms = ["".join(rng.choices("abcé🙂 ", k=rng.randrange(0, 6))) for _ in range(80)] + ["needle", "yend", "xxxxxx", "zzz", "x"]
    got = expand.names_holding(spark.createDataFrame([(n,) for n in names], "name string"), spark.createDataFrame([(t,) for t in terms], "token string")).collect()
    assert sorted((r.name, r.token) for r in got) == sorted({(n, t) for n in names for t in terms if t and t in n})


def test_names_are_not_carried_by_their_pieces(spark):
    """Names are told by digests; terms within a word and terms with a space."""
    words = ["alpha", "beta", "gamma", "delta", "alphabet"]
    names = [" ".join(words[k % 5 :] + [f"w{k}"] * 3) for k in range(300)]
    terms = ["alpha", "bet", "w1", "a b", "a", "nothing"]
    df = spark.createDataFrame([(n,) for n in names], "name string")
    held = expand.held_by(df, spark.createDataFrame([(t,) for t in terms], "token string"))
    assert held.columns == ["id", "token"]
    got = sorted((r.token, bytes(r.id)) for r in held.collect())
    assert got == sorted((t, hashlib.sha256(n.encode()).digest()) for n in set(names) for t in terms if t in n)


def test_canonical_intervals(spark):
    rng = random.Random(4)
    spans = [(lo, lo + size) for lo, size in ((rng.randrange(-100, 3000), rng.randrange(0, 3000)) for _ in range(300))] + [(5, 5), (0, 1), (0, 4096)]
    for levels in (3, 14):
        rows = spark.createDataFrame([(k, lo, hi) for k, (lo, hi) in enumerate(spans)], "k long, lo long, hi long").select("k", temporal.canonical(F.col("lo"), F.col("hi"), levels).alias("i")).collect()
        for r in rows:
            lo, hi = spans[r.k]
            covered = [x for level, slot in r.i for x in range(slot << level, (slot + 1) << level)]
            assert sorted(covered) == list(range(lo, hi)), (lo, hi, r.i)
            assert levels == 3 or len(r.i) <= 2 * math.log2(hi - lo + 2) + 1


def test_many_moments_by_brute_force(spark):
    rng = random.Random(5)
    facts = [(k, rng.randrange(0, 10**7), rng.choice([None, rng.randrange(0, 2 * 10**7)])) for k in range(200)]
    moments = [(q, rng.randrange(-(10**5), 12 * 10**6)) for q in range(60)]
    got = temporal.as_of_many(spark.createDataFrame(facts, "edge_id long, t_valid long, t_invalid long"), spark.createDataFrame(moments, "query_id long, moment long")).select("query_id", "edge_id").collect()
    assert sorted(map(tuple, got)) == sorted((q, k) for q, m in moments for k, a, b in facts if a <= m and (b is None or b > m))


@pytest.mark.parametrize("seed, nodes, n", [(1, 12, 60), (2, 30, 80), (3, 6, 40)])
def test_multihop_cases_by_brute_force(spark, seed, nodes, n):
    """Dense graphs, parallel edges and loops: hubs whose first edges all meet pairwise."""
    rng = random.Random(seed)
    edges = [(k, rng.randrange(nodes), rng.randrange(nodes)) for k in range(n)]
    real = [e for e in edges if e[1] != e[2]]
    near = {frozenset(e[1:]) for e in real}
    want = []
    for hub in range(nodes):
        arms = sorted((e, b if a == hub else a) for e, a, b in real if hub in (a, b))
        found = [(hub, x[0], y[0]) for x, y in itertools.combinations(arms, 2) if x[1] != y[1] and frozenset((x[1], y[1])) not in near]
        want += found[:6]
    got = evalkit.multihop_cases(spark.createDataFrame(edges, "edge_id long, start_id long, end_id long"))
    assert sorted((r.hub, r.a, r.b) for r in got.collect()) == sorted(want)


def test_sweep_equals_separate_runs(spark):
    rows = some_facts(230, seed=9, scopes="a")
    facts, queries = table_of(spark, rows), some_queries(spark, 5).drop("group_id")
    got = sorted((r.query_id, r["size"], r.edge_id, r.score, r["rank"]) for r in nested.sweep(queries, facts, ["edge_id"], 4).collect())
    want = []
    for size in (230, 115, 57, 28):
        part = table_of(spark, sorted(rows, key=lambda r: r[1])[:size])
        want += [(r.query_id, size, r.edge_id, r.score, r["rank"]) for r in lexical.bm25(queries, part, 4).collect()]
    assert got == sorted(want)
    assert nested.sweep(queries, facts.limit(10), ["edge_id"]).collect() == []


def test_arms_by_hand(spark):
    facts = spark.createDataFrame([(1, "a" * 40), (2, "b" * 80), (3, "c" * 4), (4, None)], "edge_id long, fact string")
    ranked = spark.createDataFrame([(7, 1, 1), (7, 2, 2), (7, 3, 3), (7, 4, 4)], "query_id long, edge_id long, rank int")
    assert sorted(map(tuple, nested.arms(ranked, facts, 15, (1, 2, 4)).collect())) == [(7, 1, 1, 10), (7, 2, 2, 30), (7, 4, 4, 31)]


def test_keys_of_a_chain_change(spark):
    ring = keychain.parse_ring("a:first, b:second")
    body = lambda k: f"claim {k}"
    claims = lambda lo, hi, key: spark.createDataFrame([("g", k, k, key, body(k)) for k in range(lo, hi)], "group_id string, seq long, verification_id long, key_id string, body string")
    first = keychain.attest(claims(1, 4, keychain.UNKEYED), ring)
    chain = first.unionByName(keychain.attest(claims(4, 7, "a"), ring, first))
    chain = chain.unionByName(keychain.attest(claims(7, 9, "b"), ring, chain)).cache()
    prev = keychain.GENESIS
    for r in chain.orderBy("seq").collect():
        message = f"{prev}\n{body(r.seq)}".encode()
        key = ring.get(r.key_id)
        made = "hmac-sha256:" + hmac.new(key.encode(), message, hashlib.sha256).hexdigest() if key else "sha256:" + hashlib.sha256(message).hexdigest()
        assert (r.prev_digest, r.digest) == (prev, made)
        prev = made
    now = spark.createDataFrame([(k, body(k) + ("!" if k == 5 else "")) for k in range(1, 9) if k != 2], "verification_id long, body string")
    findings = lambda links, keys: {r.seq: (r.finding, r.broken) for r in keychain.verify(links, now, keys).collect() if r.finding or r.broken}
    assert findings(chain, ring) == {2: ("vanished", False), 5: ("altered", False)}
    assert findings(chain.where("seq != 6"), {"a": "first"}) == {2: ("vanished", False), 5: ("altered", False), 7: ("unverifiable", True), 8: ("unverifiable", False)}
    r = keychain.report(keychain.verify(chain, now, ring)).first()
    assert (r.n_attested, r.altered, r.vanished, r.unverifiable, r.broken, r.keyed, r.mixed_keying, r.key_ids) == (8, 1, 1, 0, 0, False, True, ["a", "b", "unkeyed"])
    with pytest.raises(ValueError):
        keychain.parse_ring("a:first, typo")


def test_heads_meet_their_claims_wherever_they_are_dealt(spark):
    """Claims numbered by a window and a chain with heads are both dealt by scope before the second turn; their partitions are merged differently."""
    from pyspark.sql import Window

    keep = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.advisoryPartitionSizeInBytes", "spark.sql.adaptive.coalescePartitions.parallelismFirst")}
    for k, v in zip(keep, ("64", "100k", "false")):
        spark.conf.set(k, v)
    try:
        rows = spark.range(40_000).select(F.concat(F.lit("g"), F.col("id") % 8).alias("group_id"), F.col("id").alias("verification_id"), F.lit(keychain.UNKEYED).alias("key_id"), F.sha2(F.col("id").cast("string"), 256).alias("body"))
        claims = rows.withColumn("seq", F.row_number().over(Window.partitionBy("group_id").orderBy("verification_id")).cast("bigint"))
        first = keychain.attest(claims.where("verification_id < 20000"), {})
        chain = first.unionByName(keychain.attest(claims.where("verification_id >= 20000"), {}, first))
        found = keychain.verify(chain, claims, {})
        assert found.where("broken OR finding IS NOT NULL").count() == 0 and found.count() == 40_000
    finally:
        for k, v in keep.items():
            spark.conf.set(k, v)
