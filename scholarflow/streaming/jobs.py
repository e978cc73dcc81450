"""Structured Streaming jobs over the attempt stream (learner_id, concept_id, ts, attempt_id, score, bloom, ...).

Aggregating jobs keep plain aggregate state behind a watermark. Folding jobs keep the state of the keys of a
bucket (`bucketed`, some of all learners) in one row with `applyInPandasWithState`, so that Python is called once a bucket and
batch, not once a key; a batch's rows of a key are folded in the order of (ts, attempt_id),
so a replay in time order gives what the batch operators give.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..config import CONFIG
from .blocks import matched, packed
from .buckets import bucketed, ordered
from .sinks import MergeSink

LATE = "10 minutes"
#: Seconds of a key of `context_join`; a part of a day.
SPAN = 6 * 3600
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def bandit(attempts: DataFrame) -> DataFrame:
    """Pulls and reward of each concept; update or complete mode."""
    return attempts.groupBy("concept_id").agg(F.count(F.lit(1)).alias("pulls"), F.sum("score").alias("total_reward"))


def rate_window(attempts: DataFrame, width: str = "1 hour") -> DataFrame:
    """Attempts of each learner in fixed windows."""
    out = attempts.withWatermark("ts", LATE).groupBy("learner_id", F.window("ts", width)).agg(F.count(F.lit(1)).alias("n"))
    return out.select("learner_id", F.col("window.start").alias("start"), "n")


def context_frequency(attempts: DataFrame) -> DataFrame:
    """Uses of each concept in the last 7 days, for every day, with approximate distinct learners."""
    out = attempts.withWatermark("ts", LATE).groupBy("concept_id", F.window("ts", "7 days", "1 day")).agg(F.count(F.lit(1)).alias("n"), F.approx_count_distinct("learner_id").alias("learners"))
    return out.select("concept_id", F.col("window.start").alias("start"), "n", "learners", ((F.col("n") >= 5) & (F.col("learners") >= 2)).alias("review"))


def sessions(attempts: DataFrame, gap: str = "30 minutes") -> DataFrame:
    """Sessions of each learner, closed by a gap without an event."""
    out = attempts.withWatermark("ts", LATE).groupBy("learner_id", F.session_window("ts", gap)).agg(F.count(F.lit(1)).alias("events"))
    return out.select("learner_id", F.col("session_window.start").alias("started"), "events")


def deduplicated(attempts: DataFrame) -> DataFrame:
    return attempts.withWatermark("ts", LATE).dropDuplicatesWithinWatermark(["attempt_id"])


def context_join(selections: DataFrame, feedback: DataFrame, late: str = LATE) -> DataFrame:
    """Feedback with every selection of its concept in the 24 hours before: an interval join with watermarks on both sides.

    State is keyed by concept and `SPAN` of time, and a selection is kept for each span in which it can be met, so that a feedback
    is held against the selections of at most a span more than its 24 hours, and a concept is dealt to many tasks.
    """
    span = lambda at: F.floor(F.unix_seconds(at) / SPAN)
    s = selections.select(F.col("concept_id").alias("s_concept"), F.col("ts").alias("s_ts"), "context").withWatermark("s_ts", late)
    s = s.withColumn("s_span", F.explode(F.sequence(span("s_ts"), span("s_ts") + 24 * 3600 // SPAN)))
    f = feedback.withWatermark("ts", late).withColumn("span", span("ts"))
    return f.join(s, F.expr("concept_id = s_concept and span = s_span and s_ts <= ts and s_ts >= ts - interval 24 hours")).select("feedback_id", "context")


def context_runs(selections: DataFrame, feedback: DataFrame) -> DataFrame:
    """`context_join` of blocks of rows: each feedback with runs of the selections that it meets; `blocks.pairs` lists them.

    State holds rows, and what is written is a run for each feedback and block that it meets, not a row for each pair. A block's time is
    the start of its span, up to `SPAN` before its rows, hence the longer delay of the watermark; spans part a day, so blocks that may hold a match are 24 hours apart at most.
    """
    s, f = packed(selections, "concept_id", "context", SPAN), packed(feedback, "concept_id", "feedback_id", SPAN)
    return matched(context_join(s, f, f"{SPAN} seconds {LATE}"), "feedback_id", "context", 24 * 3600)


def critical_failures(attempts: DataFrame) -> DataFrame:
    """Attempts below the alert score; stateless (`stateful.alerts` numbers them)."""
    return attempts.filter(F.col("score") < CONFIG.alert).select("attempt_id", "learner_id", "concept_id", F.lit("CRITICAL_FAILURE").alias("alert"))


def note_events(attempts: DataFrame) -> DataFrame:
    """The note that each evaluation gives rise to, with what it is about: a misconception note needs a misconception."""
    kind = F.when(F.col("score") < CONFIG.proceed, "MISCONCEPTION_NOTE").otherwise("ATOMIC_NOTE")
    about = F.when(F.col("score") >= CONFIG.proceed, F.concat(F.lit("concept "), F.col("concept_id").cast("string"))).when(F.col("err") != "INCOMPLETE", F.col("err"))
    return attempts.select("attempt_id", "learner_id", kind.alias("note_type"), about.alias("about"))


def merged_notes(attempts: DataFrame, where: str) -> MergeSink:
    """Runs the note events of a stream into a `MergeSink` under `where`; notes without a subject fail, are retried and then kept aside."""
    sink = MergeSink(where, ["attempt_id"], lambda rows: F.col("about").isNotNull())
    note_events(attempts).writeStream.option("checkpointLocation", f"{where}/checkpoint").trigger(availableNow=True).foreachBatch(sink).start().awaitTermination()
    return sink


def _step(score: float, bloom: str) -> float:
    if score >= 0.9 and bloom in ("UNDERSTAND", "APPLY", "ANALYZE"):
        return CONFIG.bloom_step
    return -CONFIG.bloom_step if score < 0.4 and bloom in ("ANALYZE", "EVALUATE", "CREATE") else 0.0


def mastery(attempts: DataFrame) -> DataFrame:
    """Moving average of mastery and attempts of each learner and concept after every batch; update mode."""

    def fold(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = {(k, c): (m, n) for k, c, m, n in zip(*state.get, strict=True)} if state.exists else {}
        rows, touched = ordered(batches, "ts", "attempt_id"), {}
        for k, c, score, bloom in zip(*(rows[x].tolist() for x in ("learner_id", "concept_id", "score", "bloom")), strict=True):
            m, n = held.get((k, c), (0.0, 0))
            held[k, c] = touched[k, c] = min(1.0, max(0.0, m * CONFIG.history_weight + score * CONFIG.session_weight + _step(score, bloom))), n + 1
        state.update(tuple(map(list, zip(*((*k, *v) for k, v in held.items()), strict=True))))
        yield pd.DataFrame([(*k, *v) for k, v in touched.items()], columns=["learner_id", "concept_id", "mastery", "attempts"])

    state = "learner_id array<long>, concept_id array<int>, m array<double>, n array<int>"
    return bucketed(attempts.select("learner_id", "concept_id", "ts", "attempt_id", "score", "bloom"), "learner_id").applyInPandasWithState(fold, "learner_id long, concept_id int, mastery double, attempts int", state, "update", GroupStateTimeout.NoTimeout)


def replay(stream: DataFrame, job: Callable[[DataFrame], DataFrame], where: str, mode: str = "append", key: list[str] | None = None, composite: bool = False) -> DataFrame:
    """Runs `job` over all that `stream` has now, into Parquet under `where`, and reads the result.

    In update mode each batch goes to a folder of its own, and the last row of each key is read: results
    of a batch that is run again replace the first, so a lost driver repeats nothing. `composite` jobs are those of `stateful`.
    """
    spark = stream.sparkSession
    if composite:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    else:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    writer = job(stream).writeStream.option("checkpointLocation", f"{where}/checkpoint").trigger(availableNow=True)
    if mode == "append":
        query = writer.format("parquet").outputMode("append").start(f"{where}/out")
        query.awaitTermination()
        return spark.read.parquet(f"{where}/out")

    def save(batch: DataFrame, n: int) -> None:
        batch.write.mode("overwrite").parquet(f"{where}/out/batch={n}")

    query = writer.outputMode(mode).foreachBatch(save).start()
    query.awaitTermination()
    rows = spark.read.parquet(f"{where}/out")
    if mode == "complete":
        return rows.join(F.broadcast(rows.agg(F.max("batch").alias("batch"))), "batch").drop("batch")  # one row
    columns = [c for c in rows.columns if c not in (*key, "batch")]
    return rows.groupBy(*key).agg(F.max_by(F.struct(*columns), "batch").alias("_x")).select(*key, "_x.*")


def routed(events: DataFrame, kind: str, schema: str) -> DataFrame:
    """The events (event_id, ts, event_type, props) of one type with their payload parsed."""
    return events.filter(F.col("event_type") == kind).select("event_id", "ts", F.from_json("props", schema).alias("p")).select("event_id", "ts", "p.*")


def tutor_events(attempts: DataFrame, width: str = "1 day") -> DataFrame:
    """Guidance events of each concept and phase in fixed windows."""
    phase = F.when(F.col("score") < 0.3, "EXPLANATION").when(F.col("score") < 0.6, "QUESTIONING").otherwise("PRACTICE")
    out = attempts.withWatermark("ts", LATE).groupBy("concept_id", phase.alias("phase"), F.window("ts", width)).agg(F.count(F.lit(1)).alias("n"))
    return out.select("concept_id", "phase", F.col("window.start").alias("start"), "n")


def _kept(rows: DataFrame, n: int) -> DataFrame:
    """The newest `n` attempt ids of each learner after every batch; update mode."""

    def fold(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = dict(zip(*state.get, strict=True)) if state.exists else {}
        new, touched = ordered(batches, "ts", "attempt_id"), {}
        for learner, ids in new.groupby("learner_id", sort=False)["attempt_id"]:
            held[learner] = touched[learner] = (list(held.get(learner, ())) + ids.tolist())[-n:]
        state.update((list(held), list(held.values())))
        yield pd.DataFrame([(k, len(v), v[-1], v[0]) for k, v in touched.items()], columns=["learner_id", "kept", "newest", "oldest"])

    return bucketed(rows.select("learner_id", "ts", "attempt_id"), "learner_id").applyInPandasWithState(fold, "learner_id long, kept int, newest long, oldest long", "learner_id array<long>, held array<array<long>>", "update", GroupStateTimeout.NoTimeout)


def sync_history(attempts: DataFrame) -> DataFrame:
    return _kept(attempts, 50)


def failures(attempts: DataFrame) -> DataFrame:
    return _kept(attempts.filter(F.col("score") < CONFIG.alert), 20)


def dialogue(turns: DataFrame) -> DataFrame:
    """Tutoring phase of each conversation after every batch of turns (conv_id, turn, is_correct); update mode."""
    names = "EXPLANATION", "QUESTIONING", "PRACTICE", "ASSESSMENT"

    def fold(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = {k: tuple(x) for k, *x in zip(*state.get, strict=True)} if state.exists else {}
        rows, touched = ordered(batches, "turn"), {}
        for k, ok in zip(rows["conv_id"].tolist(), rows["is_correct"].tolist(), strict=True):
            phase, tries, right, n = held.get(k, (0, 0, 0, 0))
            tries, right, n = tries + 1, right + int(ok), n + 1
            if (phase == 0 and tries >= 2) or (phase == 1 and (right >= 2 or tries >= 3)) or (phase == 2 and tries >= 3):
                phase, tries, right = phase + 1, 0, 0
            held[k] = touched[k] = phase, tries, right, n
        state.update(tuple(map(list, zip(*((k, *v) for k, v in held.items()), strict=True))))
        yield pd.DataFrame([(k, names[v[0]], v[3]) for k, v in touched.items()], columns=["conv_id", "phase", "turns"])

    state = "conv_id array<long>, phase array<int>, tries array<int>, right array<int>, n array<int>"
    return bucketed(turns, "conv_id").applyInPandasWithState(fold, "conv_id long, phase string, turns int", state, "update", GroupStateTimeout.NoTimeout)


def artifacts(attempts: DataFrame) -> DataFrame:
    """Notes of each kind that the attempts of a learner give rise to; update or complete mode."""
    good = F.col("score") >= CONFIG.proceed
    return attempts.groupBy("learner_id").agg(F.count(F.when(good, 1)).alias("atomic"), F.count(F.when(~good, 1)).alias("misconception"))
