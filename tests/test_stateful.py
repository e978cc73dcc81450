"""Timers and composite state over small streams."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from scholarflow.store import new_folder
from scholarflow.streaming import jobs, stateful

SCHEMA = "learner_id long, concept_id long, ts timestamp, attempt_id long, score double, difficulty int, qtype string, err string"
DAY = 24 * 60


def attempt(n, learner, concept, minute, score, err="CARELESS"):
    return learner, concept, minute, n, score, 3, "conceptual", err


class Stream:
    """Attempts in folders of files, one file a batch."""

    def __init__(self, spark):
        self.spark, self.where = spark, new_folder(spark, "attempts")

    def add(self, rows):
        df = self.spark.createDataFrame(rows, "learner_id long, concept_id long, m long, attempt_id long, score double, difficulty int, qtype string, err string")
        df = df.withColumn("ts", F.timestamp_seconds(F.lit(1_700_000_000) + F.col("m") * 60)).drop("m")
        df.select(*[c.split()[0] for c in SCHEMA.split(", ")]).coalesce(1).write.mode("append").parquet(self.where)
        return self

    def read(self):
        return self.spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(self.where)


def ran(stream, job, where):
    return jobs.replay(stream.read(), job, where, composite=True)


def alerts_of(rows):
    return sorted((r["alert"], r["learner_id"], r["attempts"], r["attempt_id"]) for r in rows.collect())


def test_stuck_when_the_limit_passes_without_mastery(spark):
    limit = stateful.STUCK_MINUTES
    s = Stream(spark).add([attempt(1, 1, 5, 0, 0.3), attempt(2, 2, 5, 0, 0.5), attempt(3, 3, 5, 0, 0.5)])
    # 2 reaches mastery in time, 3 only after the limit
    s.add([attempt(4, 1, 5, 60, 0.2), attempt(5, 2, 5, limit, 0.95)]).add([attempt(6, 3, 5, limit + 1, 0.95)])
    s.add([attempt(7, 9, 9, limit + 60, 0.6)]).add([attempt(8, 9, 9, limit + 61, 0.6), attempt(9, 1, 5, limit + 62, 0.1)])
    got = alerts_of(ran(s, stateful.alerts, new_folder(spark, "alerts")))
    assert got == [("CRITICAL_FAILURE", 1, 1, 1), ("CRITICAL_FAILURE", 1, 2, 4), ("CRITICAL_FAILURE", 1, 3, 9), ("LEARNER_STUCK", 1, 2, None), ("LEARNER_STUCK", 3, 1, None)]


def test_a_restart_from_the_checkpoint_changes_nothing(spark):
    first = [attempt(k, k % 3, k % 4, 30 * k, (k * 7 % 11) / 10, "CONCEPTUAL" if k % 5 == 0 else "CARELESS") for k in range(1, 30)]
    second = [attempt(k, k % 3, k % 4, 30 * k, (k * 5 % 11) / 10) for k in range(30, 60)]
    whole = Stream(spark).add(first).add(second)
    want = stateful.snapshots(ran(whole, stateful.profile, new_folder(spark, "whole")))
    parts, where = Stream(spark).add(first), new_folder(spark, "parts")
    ran(parts, stateful.profile, where)
    got = stateful.snapshots(ran(parts.add(second), stateful.profile, where))
    for a, b in zip(want, got, strict=True):
        assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect()), key=str) or sorted(map(str, a.collect())) == sorted(map(str, b.collect()))
    people = {r["learner_id"]: r for r in got[0].collect()}
    assert people[0]["version"] == 19 and people[0]["errors"] == sum(1 for k in range(1, 30) if k % 5 == 0 and k % 3 == 0)


@pytest.mark.parametrize("back", [False, True])
def test_concepts_leave_the_map_after_their_time(spark, back):
    s = Stream(spark).add([attempt(1, 1, 5, 0, 1.0), attempt(2, 1, 6, 0, 0.5)]).add([attempt(3, 1, 6, 2 * DAY, 0.5)])
    s.add([attempt(4, 2, 1, 3 * DAY, 0.5)]).add([attempt(5, 1, 5, 3 * DAY + 60, 0.9)] if back else [attempt(5, 2, 1, 3 * DAY + 60, 0.5)])
    people, concepts = stateful.snapshots(ran(s, lambda a: stateful.profile(a, 2.5), new_folder(spark, "expiry")))
    mean = {r["learner_id"]: r["mean_level"] for r in people.collect()}
    assert abs(mean[1] - (0.7 if back else 0.5)) < 1e-9
    assert {r["concept_id"] for r in concepts.filter("learner_id = 1").collect()} == ({5, 6} if back else {6})
