"""Streams with composite state and timers, by `transformWithStateInPandas` on RocksDB.

Each function takes the attempt stream and returns a stream of rows for append mode. Learners are dealt to buckets, whose state
and one timer are kept together: calls of Python, state and timers are per bucket and batch, not per learner and concept. The rows of a bucket in a batch are
handled in the order of (ts, attempt_id), so a replay in time order gives what the SQL of the registered queries gives.
`replay` in `jobs` turns on the RocksDB store that this state needs.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..config import CONFIG
from ..functions.rules import bloom_level
from .buckets import bucketed, ordered

#: How late an attempt may be.
LATE = "10 minutes"
#: Minutes after the first attempt at which a learner without mastery is stuck.
STUCK_MINUTES = 3 * 24 * 60
#: Days of events after which a concept that a profile has not seen again leaves its map.
KEEP_DAYS = 180
#: An interest loses a twentieth of its weight with every later evaluation, and goes below a tenth.
DECAY, LEAST_INTEREST = 0.95, 0.1
#: Every so many evaluations the pace of a learner is checked.
PACE_EVERY = 10


def _columns(rows: Iterator[pd.DataFrame], *names: str) -> Iterator[tuple]:
    """The rows of a batch in order, as tuples of milliseconds and the columns of these names."""
    x = ordered(rows, "ts", "attempt_id")
    if not len(x):
        return iter(())
    at = x["ts"].dt.tz_localize("UTC") if x["ts"].dt.tz is None else x["ts"]
    return zip((at.astype("datetime64[ns, UTC]").astype("int64") // 1_000_000).tolist(), *(x[n].tolist() for n in names), strict=True)


def _load(state) -> list[tuple]:
    return list(zip(*state.get(), strict=True)) if state.exists() else []


def _save(state, rows: list[tuple]) -> None:
    """A value state of arrays, one for each field of `rows`."""
    if rows:
        state.update(tuple(map(list, zip(*rows, strict=True))))
    else:
        state.clear()


class BucketTimer:
    """The one timer of a bucket: at the first time at which something of it is due."""

    def __init__(self, handle: StatefulProcessorHandle):
        self.handle, self.at = handle, handle.getValueState("timer", "at long")

    def set(self, first: int | None) -> None:
        held = self.at.get()[0] if self.at.exists() else None
        if held is not None and (first is None or first != held):
            self.handle.deleteTimer(held)
            self.at.clear()
        if first is not None and first != held:
            self.handle.registerTimer(first)
            self.at.update((first,))

    def fired(self, first: int | None) -> None:
        """After the timer went off: Spark has deleted it."""
        self.at.clear()
        self.set(first)


class Alerts(StatefulProcessor):
    """Numbers the attempts of learners at concepts; a time runs from the first one until mastery or the limit."""

    def __init__(self, limit_minutes: int):
        self.limit = limit_minutes * 60_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.tries = handle.getValueState("tries", "learner array<long>, concept array<long>, n array<long>")
        # only until the limit: its time, the attempts until then, and whether mastery came by then
        self.open = handle.getValueState("open", "learner array<long>, concept array<long>, until array<long>, n array<long>, mastered array<boolean>")
        self.timer = BucketTimer(handle)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        tries = {(k, c): n for k, c, n in _load(self.tries)}
        opened = {(k, c): state for k, c, *state in _load(self.open)}
        out = []
        for at, learner, concept, attempt, score in _columns(rows, "learner_id", "concept_id", "attempt_id", "score"):
            k = learner, concept
            n = tries[k] = tries.get(k, 0) + 1
            if n == 1:
                opened[k] = [at + self.limit, 0, False]
            state = opened.get(k)
            if state and at <= state[0]:
                state[1], state[2] = state[1] + 1, bool(state[2] or score >= CONFIG.mastered)
            if score < CONFIG.alert:
                out.append(("CRITICAL_FAILURE", learner, concept, attempt, n, score, None))
        _save(self.tries, [(*k, n) for k, n in tries.items()])
        self._keep(opened, self.timer.set)
        yield _alerts(out)

    def _keep(self, opened: dict, timer) -> None:
        _save(self.open, [(*k, *state) for k, state in opened.items()])
        timer(min((state[0] for state in opened.values()), default=None))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = max(timerValues.getCurrentWatermarkInMs() - 1, expiredTimerInfo.getExpiryTimeInMs())
        out, left = [], {}
        for learner, concept, *state in _load(self.open):
            if state[0] > now:
                left[learner, concept] = state
            elif not state[2]:
                out.append(("LEARNER_STUCK", learner, concept, None, state[1], None, self.limit // 60_000))
        self._keep(left, self.timer.fired)
        yield _alerts(out)

    def close(self) -> None:
        pass


_ALERT = {"alert": "str", "learner_id": "Int64", "concept_id": "Int64", "attempt_id": "Int64", "attempts": "Int64", "score": "Float64", "minutes": "Int64"}


def _alerts(rows: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=list(_ALERT)).astype({k: t for k, t in _ALERT.items() if t != "str"})


def alerts(attempts: DataFrame, limit_minutes: int = STUCK_MINUTES) -> DataFrame:
    """CRITICAL_FAILURE for each attempt below the alert score, with its number; LEARNER_STUCK when `limit_minutes` have passed since a learner's first
    attempt at a concept and none of those so far reached mastery. What runs until the limit goes when that has passed; the number of attempts stays."""
    rows = attempts.select("learner_id", F.col("concept_id").cast("long").alias("concept_id"), "ts", "attempt_id", "score").withWatermark("ts", LATE)
    schema = "alert string, learner_id long, concept_id long, attempt_id long, attempts long, score double, minutes long"
    return bucketed(rows, "learner_id").transformWithStateInPandas(Alerts(limit_minutes), schema, "Append", "EventTime")


class Profile(StatefulProcessor):
    """Learners' maps of concepts, and the sums that go with them. Entries have a time to live in event time: a timer takes the old ones out."""

    def __init__(self, keep_days: float):
        self.keep = int(keep_days * 24 * 3600 * 1000)

    def init(self, handle: StatefulProcessorHandle) -> None:
        entry = "score array<double>, bloom array<string>, difficulty array<int>, version array<long>, completed array<boolean>, at array<long>"
        self.concepts = handle.getValueState("concepts", f"learner array<long>, concept array<long>, {entry}")
        sums = "version array<long>, known array<long>, total array<double>, completed array<long>, errors array<long>, minutes array<double>, passed array<long>, advanced array<long>"
        self.sums = handle.getValueState("sums", f"learner array<long>, {sums}")
        self.timer = BucketTimer(handle)

    def _held(self) -> tuple[dict, dict]:
        return {(k, c): tuple(x) for k, c, *x in _load(self.concepts)}, {k: tuple(x) for k, *x in _load(self.sums)}

    def _keep(self, held: dict, sums: dict, timer) -> None:
        _save(self.concepts, [(*k, *x) for k, x in held.items()])
        _save(self.sums, [(k, *x) for k, x in sums.items()])
        timer(min((x[5] + self.keep for x in held.values()), default=None))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        held, sums = self._held()
        out, touched, learners = [], set(), set()
        for at, learner, concept, score, difficulty, err, estimate, spent in _columns(rows, "learner_id", "concept_id", "score", "difficulty", "err", "estimate", "minutes"):
            version, known, total, completed, errors, minutes, passed, advanced = sums.get(learner, (0, 0, 0.0, 0, 0, 0.0, 0, 0))
            version += 1
            k = learner, concept
            before = held.get(k)
            mean = total / known if known else 0.0
            known, total = known + (before is None), total + score - (before[0] if before else 0.0)
            done = score >= CONFIG.proceed or bool(before and before[4])
            completed += done and not (before and before[4])
            errors += err == "CONCEPTUAL"
            minutes, passed = minutes + spent, passed + (score >= 0.6)
            held[k] = score, estimate, difficulty, version, done, at
            touched.add(k)
            learners.add(learner)
            if abs(total / known - mean) > 0.1 + 1e-9:
                advanced += 1
                out.append((learner, "PROFILE_ADVANCED", version, None, total / known, None, None, None, None, None, None))
            if version % PACE_EVERY == 0:
                hours, ratio = minutes / 60, 2 * passed / version
                velocity = completed / hours if hours > 0 else 0.0
                event = None if abs(velocity - 1.0) <= 0.3 + 1e-9 else "LEARNER_ACCELERATING" if velocity > 1.0 else "LEARNER_SLOWING"
                prefers = "HARD" if ratio > 1.2 + 1e-9 else "EASY" if ratio < 0.8 - 1e-9 else "MEDIUM"
                out.append((learner, "PACE", version, None, velocity, prefers, event, None, None, None, None))
            sums[learner] = version, known, total, completed, errors, minutes, passed, advanced
        for k in touched:
            score, estimate, _, seen, done, _ = held[k]
            out.append((k[0], "CONCEPT", sums[k[0]][0], k[1], score, estimate, None, seen, int(done), None, None))
        self._keep(held, sums, self.timer.set)
        yield _told(out, learners, sums)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        """Drops the concepts that were last seen a time to live ago; the mean is then of the others, and a concept that comes back is new."""
        last = max(timerValues.getCurrentWatermarkInMs() - 1, expiredTimerInfo.getExpiryTimeInMs()) - self.keep
        held, sums = self._held()
        old = [k for k, x in held.items() if x[5] <= last]
        out = []
        for k in old:
            version, known, total, *rest = sums[k[0]]
            known, total = known - 1, total - held.pop(k)[0]
            sums[k[0]] = version, known, total if known else 0.0, *rest
            out.append((k[0], "DROPPED", version, k[1], None, None, None, None, None, None, None))
        self._keep(held, sums, self.timer.fired)
        yield _told(out, {k for k, _ in old}, sums)

    def close(self) -> None:
        pass


_PROFILE = {
    "learner_id": "Int64", "kind": "str", "version": "Int64", "concept_id": "Int64", "level": "Float64", "text": "str", "event": "str", "seen": "Int64", "completed": "Int64", "errors": "Int64", "advanced": "Int64",
}
PROFILE_SCHEMA = "learner_id long, kind string, version long, concept_id long, level double, text string, event string, seen long, completed long, errors long, advanced long"


def _told(out: list[tuple], learners: set, sums: dict) -> pd.DataFrame:
    """`out` and the newest profile of these learners, as rows of `PROFILE_SCHEMA`."""
    for k in learners:
        version, known, total, completed, errors, _, _, advanced = sums[k]
        out.append((k, "PROFILE", version, None, total / known if known else 0.0, None, None, None, completed, errors, advanced))
    return pd.DataFrame(out, columns=list(_PROFILE)).astype({k: t for k, t in _PROFILE.items() if t != "str"})


def profile(attempts: DataFrame, keep_days: float = KEEP_DAYS) -> DataFrame:
    """What changes in the profiles of learners, as rows of several kinds, each with the profile's version (evaluations so far):

    CONCEPT: latest score and Bloom estimate of a concept, the version it is of, and whether it was ever completed;
    PROFILE: mean of the map, completed concepts, conceptual errors, changes told; PROFILE_ADVANCED: an evaluation that moved the mean
    by more than a tenth; PACE: every `PACE_EVERY` evaluations, completed concepts an hour, the difficulty to prefer, and an event if the
    velocity is off by more than 0.3; DROPPED: a concept that was not seen for `keep_days`. `snapshots` makes tables of these rows.
    """
    rows = attempts.withColumn("estimate", bloom_level(F.col("score"), F.col("difficulty"), F.col("qtype"))).withColumn("minutes", 5.0 + F.col("difficulty"))
    rows = rows.select("learner_id", F.col("concept_id").cast("long").alias("concept_id"), "ts", "attempt_id", "score", "difficulty", "err", "estimate", "minutes").withWatermark("ts", LATE)
    return bucketed(rows, "learner_id").transformWithStateInPandas(Profile(keep_days), PROFILE_SCHEMA, "Append", "EventTime")


def snapshots(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The newest profile of each learner (learner_id, version, mean_level, completed, errors, advanced), and its map of concepts
    (learner_id, concept_id, level, bloom, completed, interest; interest decays with the evaluations since and is null below a tenth)."""
    at = F.struct("version")
    people = rows.filter("kind = 'PROFILE'").groupBy("learner_id").agg(F.max("version").alias("version"), *[F.max_by(c, at).alias(n) for c, n in (("level", "mean_level"), ("completed", "completed"), ("errors", "errors"), ("advanced", "advanced"))])
    newest = rows.filter("kind in ('CONCEPT', 'DROPPED')").groupBy("learner_id", "concept_id").agg(F.max_by(F.struct("kind", "level", "text", "completed", "seen"), F.struct("version", "kind")).alias("x"))
    newest = newest.filter("x.kind = 'CONCEPT'")
    weight = F.pow(F.lit(DECAY), F.col("version") - F.col("x.seen"))
    concepts = newest.join(people.select("learner_id", "version"), "learner_id").select(
        "learner_id", "concept_id", "x.level", F.col("x.text").alias("bloom"), "x.completed", F.when(weight >= LEAST_INTEREST, weight).alias("interest"))
    return people, concepts
