"""Arrays read in parts, and the stateful door against a model of it in plain Python."""

import json
import random
from collections import defaultdict

import pytest

from palimpsest.operators import events
from palimpsest.sources import arrays, corpora
from palimpsest.streaming import door, inbox


def objects(n, seed=1):
    rng = random.Random(seed)
    bits = ["}", "{", '"', "\\", "[", "]", "},{", ' "a": 1}', "é", "🙂", "\n", "plain ", "\\\\", '\\"']
    return [{"id": k, "text": "".join(rng.choices(bits, k=rng.randrange(12))), "deep": {"x": [{"y": "".join(rng.choices(bits, k=4))}] * rng.randrange(3)}} for k in range(n)]


SCHEMA = "id long, text string, deep struct<x:array<struct<y:string>>>"


@pytest.mark.parametrize("size", [16, 150, 1 << 20])
def test_arrays_in_blocks_of_any_size(spark, tmp_path, size):
    for k, (indent, n) in enumerate([(None, 9), (2, 4), (None, 0), (None, 1)]):
        (tmp_path / f"{k}.json").write_text("  \n" + json.dumps(objects(n, k), indent=indent, ensure_ascii=bool(k % 2)) + "\n", encoding="utf-8")
    before = {c: spark.conf.get(c) for c in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", str(size))
        spark.conf.set("spark.sql.files.openCostInBytes", "0")
        got = arrays.json_array(spark, str(tmp_path), SCHEMA).collect()
        want = spark.read.option("multiLine", True).schema(SCHEMA).json(str(tmp_path)).collect()
        assert sorted(map(str, got)) == sorted(map(str, want)) and len(got) == 14
        first = arrays.json_array(spark, str(tmp_path / "0.json"), SCHEMA, limit=4).collect()
        assert [r.id for r in first] == [0, 1, 2, 3]
        if size == 16:
            assert arrays.json_objects(spark, str(tmp_path / "0.json")).select("block").distinct().count() > 5
    finally:
        for c, v in before.items():
            spark.conf.set(c, v)


def test_corpora_read_arrays_in_parts(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps([{"id": 1, "text": "a } b"}, {"id": 2, "text": None}]))
    assert sorted((r.id, r.text) for r in corpora.json_array(spark, str(tmp_path / "a.json"), "id long, text string").collect()) == [(1, "a } b"), (2, None)]


def envelope(k, group, at, subject="deal", event_id=None, version=1):
    return {"group_id": group, "event_id": event_id or f"evt:{k:08d}", "event_type": "decision.recorded", "schema_version": version, "occurred_at": at - 5, "received_at": at, "agent": "u", "payload": "{}", "scope_group": None, "arrival": k, "sign": "success", "subject": subject}


class Model:
    """The door in plain Python, a micro-batch at a time."""

    def __init__(self, limit, most):
        self.limit, self.most, self.waiting, self.seen, self.drained = limit, most, defaultdict(list), defaultdict(dict), defaultdict(int)

    def take(self, batch):
        out, groups = [], defaultdict(list)
        for e in batch:
            groups[e["group_id"]].append(e)
        for g in {*groups, *(g for g, w in self.waiting.items() if w)}:
            for e in sorted(groups[g], key=lambda e: (e["received_at"], e["arrival"])):
                i = e["event_id"]
                if e["schema_version"] != 1:
                    out.append((g, i, "refused", "schema_version", 0))
                elif i in self.seen[g] and e["received_at"] - self.seen[g][i] <= events.MAX_AGE:
                    out.append((g, i, "duplicate", None, 0))
                elif len(self.waiting[g]) >= self.most:
                    out.append((g, i, "refused", "backlog", 0))
                else:
                    self.seen[g][i] = e["received_at"]
                    self.waiting[g].append((e["received_at"], i, e["subject"]))
            self.waiting[g].sort()
            for _, i, subject in self.waiting[g][: self.limit]:
                self.drained[g] += 1
                out.append((g, i, "applied" if subject.strip() else "rejected", None if subject.strip() else "subject", self.drained[g]))
            del self.waiting[g][: self.limit]
        return out


def test_stateful_door_equals_its_model_over_a_restart(spark, tmp_path):
    rng = random.Random(7)
    source, sink, state = (tmp_path / n for n in ("in", "out", "state"))
    source.mkdir()
    start, batches, k = 1_700_000_000, [], 0
    for b in range(3):
        batch = []
        for _ in range(22):
            k += 1
            known = rng.random() < 0.2 and k > 5
            batch.append(envelope(k, rng.choice("ab"), start + 100 * b + rng.randrange(90), rng.choice(["deal", "deal", " "]), f"evt:{rng.randrange(1, k):08d}" if known else None, 2 if rng.random() < 0.1 else 1))
        batches.append(batch)
    model, want = Model(limit=3, most=8), []
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        for b, batch in enumerate(batches):  # a stream that stops after each batch and goes on from its checkpoint
            (source / f"{b}.json").write_text("\n".join(map(json.dumps, batch)))
            q = door.door(inbox.source(spark, str(source)), limit=3, most=8).writeStream.format("parquet").option("path", str(sink)).option("checkpointLocation", str(state)).trigger(availableNow=True).start()
            q.awaitTermination()
            want += model.take(batch) + model.take([])  # the watermark moves once behind each batch
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    rows = spark.read.parquet(str(sink)).collect()
    got = [(r.group_id, r.event_id, r.outcome, r.error, r.position) for r in rows]
    assert {x[2] for x in want} == {"applied", "rejected", "refused", "duplicate"} and any(x[3] == "backlog" for x in want)
    assert sorted(got, key=str) == sorted(want, key=str)
    assert all(r.attempts == (1 if r.outcome in ("applied", "rejected") else 0) for r in rows)


def test_sessions_of_agents(spark, tmp_path):
    (tmp_path / "in").mkdir()
    times = [0, 100, 1000, 5000, 5100, 3_000_000]
    (tmp_path / "in" / "0.json").write_text("\n".join(json.dumps(envelope(k, "a", 1_700_000_000 + t)) for k, t in enumerate(times)))
    q = door.sessions(inbox.source(spark, str(tmp_path / "in"))).writeStream.format("memory").queryName("agent_sessions").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted(r.n for r in spark.table("agent_sessions").collect()) == [2, 3]
