"""Record keeping and upkeep on tables made by hand."""

import numpy as np
from pyspark.sql import functions as F

from palimpsest.functions import embedding
from palimpsest.operators import records, upkeep


def rows(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


def test_hash_embedder_is_deterministic_and_unit(spark):
    a, b, c = embedding.hashed(["red widget", "red widget", ""], 64)
    assert a == b and len(a) == 64 and abs(np.linalg.norm(a) - 1) < 1e-12 and abs(np.linalg.norm(c) - 1) < 1e-12
    df = spark.createDataFrame([(1, "x y"), (2, None)], "edge_id bigint, fact string")
    assert [len(r.vector) for r in upkeep.reindex(df).collect()] == [384, 384]


def test_signatures():
    m = {"b": 1, "a": "é"}
    s = upkeep.sign(m, b"k")
    assert upkeep.signed_by({"a": "é", "b": 1}, s, b"k") and not upkeep.signed_by(m, s, b"other") and not upkeep.signed_by({**m, "b": 2}, s, b"k")


def test_policies_and_trials(spark):
    p = spark.createDataFrame([("g", 5, 1, None), ("h", 7, 1, None)], "group_id string, days bigint, created_at bigint, retired_at bigint")
    got = upkeep.set_policy(p, "g", 9, 50)
    assert rows(got.where("retired_at IS NULL"), "group_id", "days") == [("g", 9), ("h", 7)]
    t = records.start_trial(spark.createDataFrame([("a", 1, None, None)], "name string, started_at bigint, ended_at bigint, reason string"), "b", 9)
    assert {r.name: (r.ended_at, r.reason) for r in t.collect()} == {"a": (9, "restarted"), "b": (None, None)}


def test_import_is_refused_whole(spark):
    reg = spark.createDataFrame([("old", "promoted")], "bundle_id string, state string")
    good = spark.createDataFrame([(1, "fine", "r", "s", "t", "extracted", 5)], "edge_id bigint, fact string, relation_type string, source string, target string, confidence string, t_valid bigint")
    bad = good.unionByName(good.withColumn("fact", F.lit("")))
    assert records.import_bundle(good, "b", "o", ["digest"], reg)[1] == "digest"
    assert records.import_bundle(good, "old", "o", [], reg)[1] == "replay"
    assert records.import_bundle(bad, "b", "o", [], reg) == (None, "empty_fact")
    facts, state = records.import_bundle(good, "b", "o", [], reg)
    assert state == "quarantined" and rows(facts, "group_id", "confidence", "origin") == [("o:import:b", "inferred", "b")]


def test_quotes_and_apportioning(spark):
    c = spark.createDataFrame([(1, 1, "this is a long enough quote"), (1, 2, "short"), (1, 3, "this is not in the text at all")], "batch int, position int, quote string")
    s = spark.createDataFrame([(1, "well, this is a long enough quote, he said")], "batch int, text string")
    assert rows(records.quote_filter(c, s), "position") == [(1,)]
    p = spark.createDataFrame([(1, "a", 2, 10), (1, "b", 1, 10), (2, "a", 0, 7)], "prompt_id int, group_id string, n_facts int, chars int")
    assert rows(records.apportion(p), "prompt_id", "group_id", "injected_chars") == [(1, "a", 7), (1, "b", 3), (2, "a", 1)]


def test_ablation_names_are_options():
    from palimpsest.operators.retrieve import Options

    assert len(upkeep.ablation()) == 15 and all(Options(**o) for o in upkeep.ablation().values())
