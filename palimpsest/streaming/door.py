"""The event door with state: what waits, what was seen and how often it was tried is kept for each scope between micro-batches and over restarts.

Each micro-batch first takes in what has come, in order of arrival: an event that was seen within the replay window is a duplicate, one that
breaks a rule is refused with the reason, one that comes while MAX_PENDING wait is refused (and may come again). Then the oldest `limit`
waiting events of the scope are taken in their order; one that can't be applied is rejected and stops none of the others. A scope
without new events goes on draining by a timer whenever the watermark moves, so a stream of other scopes' events is enough, and a run that reads
what there is comes to an end. Ids that have left the replay window are forgotten.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators import events

OUTCOMES = "group_id string, event_id string, outcome string, error string, attempts int, position long, received_at long"
_WAITING = "event_id string, received_at long, agent string, event_type string, subject string, sign string, occurred_at long, error string"
_FIELDS = [f.split()[0] for f in _WAITING.split(", ")]


class Door(StatefulProcessor):
    """One scope's door. drained: (count,) of all events taken so far."""

    def __init__(self, limit: int, most: int, window: int):
        self.limit, self.most, self.window = limit, most, window

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getMapState("waiting", "place string", _WAITING)
        self.seen = handle.getMapState("seen", "event_id string", "received_at long")
        self.counts = handle.getValueState("counts", "waiting long, drained long, clock long")

    def _numbers(self) -> list[int]:
        return [int(v) for v in self.counts.get()] if self.counts.exists() else [0, 0, 0]

    def _drain(self, group: str, waiting: int, drained: int) -> tuple[list[tuple], int, int]:
        """Takes the oldest. State of a scope holds `most` waiting events at most, so they are sorted here."""
        out = []
        for place, row in sorted((k[0], tuple(v)) for k, v in self.waiting.iterator())[: self.limit]:
            e = dict(zip(_FIELDS, row))
            self.waiting.removeKey((place,))
            waiting, drained = waiting - 1, drained + 1
            out.append((group, e["event_id"], "rejected" if e["error"] else "applied", e["error"], 1, drained, int(e["received_at"])))
        return out, waiting, drained

    def _timer(self, waiting: int, timers) -> None:
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        if waiting:
            self.handle.registerTimer(timers.getCurrentWatermarkInMs() + 1)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        group = key[0]
        waiting, drained, clock = self._numbers()
        came = pd.concat(list(rows)).sort_values(["received_at", "arrival"], kind="stable")
        out = []
        for r in came.itertuples(index=False):
            at = int(r.received_at)
            clock = max(clock, at)
            error = None if pd.isna(r.reason) else r.reason
            said = (group, r.event_id, "refused", error, 0, 0, at)
            if error:
                out.append(said)
            elif self.seen.containsKey((r.event_id,)) and at - int(self.seen.getValue((r.event_id,))[0]) <= self.window:
                out.append((*said[:2], "duplicate", None, 0, 0, at))
            elif waiting >= self.most:
                out.append((*said[:3], "backlog", 0, 0, at))
            else:
                self.seen.updateValue((r.event_id,), (at,))
                fields = [r.event_id, at, r.agent, r.event_type, r.subject, r.sign, int(r.occurred_at), None if pd.isna(r.inapplicable) else r.inapplicable]
                self.waiting.updateValue((f"{at:020d} {r.event_id}",), tuple(fields))
                waiting += 1
        for (event_id,) in [k for k, v in self.seen.iterator() if clock - int(v[0]) > self.window]:
            self.seen.removeKey((event_id,))
        taken, waiting, drained = self._drain(group, waiting, drained)
        self.counts.update((waiting, drained, clock))
        self._timer(waiting, timerValues)
        yield self._frame(out + taken)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        waiting, drained, clock = self._numbers()
        taken, waiting, drained = self._drain(key[0], waiting, drained)
        self.counts.update((waiting, drained, clock))
        self._timer(waiting, timerValues)
        yield self._frame(taken)

    @staticmethod
    def _frame(rows: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame(rows, columns=[f.split()[0] for f in OUTCOMES.split(", ")])

    def close(self) -> None:
        pass


def door(stream: DataFrame, limit: int = 100, most: int = events.MAX_PENDING, window: int = events.MAX_AGE) -> DataFrame:
    """What becomes of each envelope: group_id, event_id, outcome (applied, rejected, refused, duplicate), error, attempts, position (its
    place among all that its scope has drained) and received_at. Needs the RocksDB state store (spark.sql.streaming.stateStore.providerClass)."""
    lost = F.when(F.coalesce(F.trim("subject"), F.lit("")) == "", "subject")
    judged = stream.withColumn("reason", events.reason(F.col("received_at"))).withColumn("inapplicable", lost)
    timed = judged.withColumn("event_time", F.timestamp_seconds("received_at")).withWatermark("event_time", f"{window} seconds")
    return timed.groupBy("group_id").transformWithStateInPandas(Door(limit, most, window), OUTCOMES, outputMode="Append", timeMode="EventTime")


def sessions(stream: DataFrame, gap: str = "30 minutes") -> DataFrame:
    """Sessions of each agent in a scope: what it sends with pauses of less than `gap` is one; late events merge sessions until the
    watermark passes."""
    timed = stream.withColumn("event_time", F.timestamp_seconds("received_at")).withWatermark("event_time", f"{events.MAX_AGE} seconds")
    per = timed.groupBy(F.session_window("event_time", gap).alias("session"), "group_id", "agent").agg(F.count("*").alias("n"))
    return per.select("group_id", "agent", F.col("session.start").alias("began"), F.col("session.end").alias("ended"), "n")
