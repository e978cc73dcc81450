"""Streaming jobs, replayed over the events of a data folder, with SQL for their batch twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..sources import tables
from ..store import new_folder
from ..streaming import blocks, jobs, stateful
from .registry import add
from .views import VIEWS


SLICES, FILES = 4, 4


def _stream(v, where=None):
    """The attempts as a stream: the events of the folder, one slice of time in every batch."""
    spark = v.spark
    events = spark.readStream.schema(v.events.schema).option("maxFilesPerTrigger", FILES).option("pathGlobFilter", "*.parquet").parquet(where or _folder(v))
    events = events.withColumn("ts", F.col("ts").cast("timestamp"))  # watermarks need it
    return spark.sql(VIEWS["attempts"], events=events)


def _folder(v) -> str:
    """Events as slices of time, written one after the other as `FILES` files each; a file source takes the oldest first."""
    where = new_folder(v.spark, "stream")
    at = F.unix_timestamp("ts")
    low, high = v.events.agg(F.min(at), F.max(at)).first()
    slice_of = F.least(F.floor((at - (low or 0)) * SLICES / max(1, (high or 0) - (low or 0))), F.lit(SLICES - 1))
    for k in range(SLICES):
        v.events.filter(slice_of == k).repartition(FILES).write.mode("append").parquet(where)
    return where


def _replay(v, job, mode="append", key=None, composite=False):
    return jobs.replay(_stream(v), job, new_folder(v.spark, "replay"), mode, key, composite)


add("stm_bandit", lambda v: _replay(v, jobs.bandit, "complete"), "select concept_id, count(*) as pulls, sum(score) as total_reward from {attempts} group by 1", "total_reward")
add("stm_mastery", lambda v: _replay(v, jobs.mastery, "update", ["learner_id", "concept_id"]))
add("stm_dedup", lambda v: _replay(v, lambda s: jobs.deduplicated(s).select("attempt_id")), "select distinct attempt_id from {attempts}")
add("stm_rate_window", lambda v: _replay(v, jobs.rate_window, "update", ["learner_id", "start"]), "select learner_id, date_trunc('hour', ts) as start, count(*) as n from {attempts} group by 1, 2", times="start")
add("stm_sessions", lambda v: _replay(v, jobs.sessions), """select learner_id, min(ts) as started, count(*) as events from (select *, sum(opens) over (partition by learner_id order by ts, attempt_id) as session from (
  select *, case when ts - lag(ts) over (partition by learner_id order by ts, attempt_id) <= interval 30 minutes then 0 else 1 end as opens from {attempts}) a) b group by learner_id, session
  having max(ts) + interval 30 minutes <= (select max(ts) from {attempts}) - interval 10 minutes""", times="started")
add("stm_context_freq", lambda v: _replay(v, jobs.context_frequency, "update", ["concept_id", "start"]).select("concept_id", "start", "n"), "select concept_id, date_trunc('day', ts) - to_days(i::int) as start, count(*) as n from {attempts}, unnest(range(7)) as t(i) group by 1, 2", times="start")


def _context(v):
    where = _folder(v)
    sel = _stream(v, where).filter("attempt_id % 2 = 0").select("concept_id", "ts", F.col("score").alias("context"))
    fb = _stream(v, where).filter("attempt_id % 2 = 1").select("concept_id", "ts", F.col("attempt_id").alias("feedback_id"))
    return blocks.pairs(jobs.replay(fb, lambda s: jobs.context_runs(sel, s), new_folder(v.spark, "replay")), "feedback_id", "context")


add("stm_context_join", _context, """select f.attempt_id as feedback_id, s.score as context from {attempts} f join {attempts} s on s.concept_id = f.concept_id and s.ts <= f.ts and s.ts >= f.ts - interval 24 hours where f.attempt_id % 2 = 1 and s.attempt_id % 2 = 0""", "context")


def _written(v, name: str, write):
    where = new_folder(v.spark, name)
    write(where)
    return where


def _progress(v):
    where = _written(v, "progress", lambda p: tables.append(v.attempts.select("learner_id", "concept_id", "score", "ts"), p, "ts"))
    return v.spark.read.parquet(where).groupBy("day").agg(F.count(F.lit(1)).alias("n")).withColumn("day", F.col("day").cast("string"))


add("sink_progress", _progress, "select cast(cast(ts as date) as varchar) as day, count(*) as n from {attempts} group by 1")
add("sink_alerts", lambda v: v.spark.read.schema("attempt_id long, alert string").json(_written(v, "alerts", lambda p: tables.alerts(jobs.critical_failures(v.attempts), p))), "select attempt_id, 'CRITICAL_FAILURE' as alert from {attempts} where score < 0.4")


def _index(v):
    from ..operators.text import fixed_chunks

    where = _written(v, "chunks", lambda p: tables.chunk_index(fixed_chunks(v.documents), p))
    return v.spark.read.parquet(where).groupBy("doc_id").agg(F.count(F.lit(1)).alias("chunks"))


add("sink_chunk_index", _index, "select doc_id, greatest(1, cast(ceil(length(text) / 2000.0) as bigint)) as chunks from documents")


def _events(v):
    return v.spark.readStream.schema(v.events.schema).option("maxFilesPerTrigger", FILES).option("pathGlobFilter", "*.parquet").parquet(_folder(v))


add("stm_route_events", lambda v: jobs.replay(_events(v), lambda s: jobs.routed(s, "error", "k int").select("event_id", "k"), new_folder(v.spark, "replay")), "select event_id, cast(json_extract_string(props, '$.k') as int) as k from events where event_type = 'error'")
add("stm_tutor_events", lambda v: _replay(v, jobs.tutor_events, "update", ["concept_id", "phase", "start"]), "select concept_id, case when score < 0.3 then 'EXPLANATION' when score < 0.6 then 'QUESTIONING' else 'PRACTICE' end as phase, date_trunc('day', ts) as start, count(*) as n from {attempts} group by 1, 2, 3", times="start")
_KEPT = "select learner_id, cast(len(a) as int) as kept, a[1] as newest, a[-1] as oldest from (select learner_id, list(attempt_id order by ts desc, attempt_id desc)[1:{}] as a from {{attempts}} {} group by 1) x"
add("stm_sync_history", lambda v: _replay(v, jobs.sync_history, "update", ["learner_id"]), _KEPT.format(50, ""))
add("stm_failures", lambda v: _replay(v, jobs.failures, "update", ["learner_id"]), _KEPT.format(20, "where score < 0.4"))


def _dialogue(v):
    where = new_folder(v.spark, "turns")
    for k in range(3):
        v.dialogue.select("conv_id", "turn", "is_correct").filter(F.least(F.floor(F.col("turn") / 3), F.lit(2)) == k).repartition(FILES).write.mode("append").parquet(where)
    turns = v.spark.readStream.schema("conv_id long, turn long, is_correct boolean").option("maxFilesPerTrigger", FILES).parquet(where)
    return jobs.replay(turns, jobs.dialogue, new_folder(v.spark, "replay"), "update", ["conv_id"])


add("stm_dialogue", _dialogue, """with o as (select conv_id, list({{'p': 0, 't': 0, 'r': case when is_correct then 1 else 0 end}} order by turn) as a from {dialogue} group by 1),
f as (select conv_id, cast(len(a) as int) as turns, list_reduce(list_prepend({{'p': 0, 't': 0, 'r': 0}}, a), lambda s, x: case when case s.p when 0 then s.t + 1 >= 2 when 1 then s.r + x.r >= 2 or s.t + 1 >= 3 when 2 then s.t + 1 >= 3 else false end then {{'p': s.p + 1, 't': 0, 'r': 0}} else {{'p': s.p, 't': s.t + 1, 'r': s.r + x.r}} end).p as p from o)
select conv_id, turns, ['EXPLANATION', 'QUESTIONING', 'PRACTICE', 'ASSESSMENT'][p + 1] as phase from f""")


def _analysis(v):
    """Bottleneck flags after every batch of attempts, written by the batch."""
    from ..operators import analytics

    where = new_folder(v.spark, "analysis")

    def save(batch, n):
        batch.groupBy("learner_id", "concept_id").agg(F.max_by("score", F.struct("ts", "attempt_id")).alias("level"), F.max(F.struct("ts", "attempt_id")).alias("at")).write.mode("overwrite").parquet(f"{where}/batch={n}")

    _stream(v).writeStream.option("checkpointLocation", f"{where}-checkpoint").trigger(availableNow=True).foreachBatch(save).start().awaitTermination()
    latest = v.spark.read.parquet(where).groupBy("learner_id", "concept_id").agg(F.max_by("level", "at").alias("level"))
    return analytics.bottlenecks(analytics.concept_stats(latest)).select("concept_id", "kind", "avg_mastery")


add("stm_system_analysis", _analysis, "select concept_id, case when avg(level) < 0.4 then 'difficult' else 'easy' end as kind, avg(level) as avg_mastery from {mastery} group by 1 having avg(level) < 0.4 or avg(level) > 0.8", "avg_mastery")
add("stm_artifacts", lambda v: _replay(v, jobs.artifacts, "complete"), "select learner_id, count(*) filter (score >= 0.8) as atomic, count(*) filter (score < 0.8) as misconception from {attempts} group by 1")

add("stm_alerts", lambda v: _replay(v, stateful.alerts, composite=True), f"""with a as (select *, row_number() over (partition by learner_id, concept_id order by ts, attempt_id) as n from {{attempts}}),
f as (select learner_id, concept_id, min(ts) + to_minutes({stateful.STUCK_MINUTES}) as until from a group by 1, 2),
s as (select learner_id, concept_id, until, count(*) as n from a join f using (learner_id, concept_id) where ts <= until group by 1, 2, 3 having max(score) < 0.9)
select 'CRITICAL_FAILURE' as alert, learner_id, concept_id::bigint as concept_id, attempt_id, n as attempts, score, null::bigint as minutes from a where score < 0.4
union all select 'LEARNER_STUCK', learner_id, concept_id, null, n, null, {stateful.STUCK_MINUTES} from s where until <= (select max(ts) from a) - interval 10 minutes""", "score")


def _profile(v):
    people, concepts = stateful.snapshots(_replay(v, stateful.profile, composite=True))
    everyone = people.select("learner_id", F.lit(None).cast("long").alias("concept_id"), F.col("mean_level").alias("level"), F.lit(None).cast("string").alias("bloom"), "completed", F.lit(None).cast("double").alias("interest"), "version", "errors", "advanced")
    return everyone.unionByName(concepts, allowMissingColumns=True)


#: Attempts with the running numbers of a learner's profile.
_RUNNING = """select *, lag(mean, 1, 0.0) over (partition by learner_id order by ts, attempt_id) as mean_before from (select *, sum(delta) over w / sum(first) over w as mean, row_number() over w as version, sum(new_done) over w as done_so_far, sum(5.0 + difficulty) over w as minutes, count(*) filter (score >= 0.6) over w as passed from (
  select *, score - coalesce(lag(score) over c, 0) as delta, case when lag(score) over c is null then 1 else 0 end as first,
    case when score >= 0.8 and coalesce(max(score) over (partition by learner_id, concept_id order by ts, attempt_id rows between unbounded preceding and 1 preceding), 0) < 0.8 then 1 else 0 end as new_done
  from {{attempts}} window c as (partition by learner_id, concept_id order by ts, attempt_id)) x window w as (partition by learner_id order by ts, attempt_id rows unbounded preceding)) y"""
_BLOOM = """['REMEMBER', 'UNDERSTAND', 'APPLY', 'ANALYZE', 'EVALUATE', 'CREATE'][cast(round_even(least(6.0, greatest(1.0, 0.60::double * b + 0.25::double * (b + s) + 0.15::double * (b + q))), 0) as int)]"""
add("stm_profile", _profile, f"""with r as ({_RUNNING.replace("{{", "{").replace("}}", "}")}),
p as (select learner_id, max(version) as version, arg_max(mean, version) as level, cast(sum(new_done) as bigint) as completed, count(*) filter (err = 'CONCEPTUAL') as errors, count(*) filter (abs(mean - mean_before) > 0.1 + 1e-9) as advanced from r group by 1),
k as (select learner_id, concept_id, arg_max(score, version) as level, arg_max(difficulty, version) as d, arg_max(qtype, version) as t, max(version) as seen, cast(max(case when score >= 0.8 then 1 else 0 end) as bigint) as completed from r group by 1, 2),
g as (select *, case when level < 0.2 then 1 when level < 0.4 then 2 when level < 0.6 then 3 when level < 0.8 then 4 when level < 0.9 then 5 else 6 end as b, case when d >= 4 then -0.5::double when d <= 2 then 0.5 else 0 end as s,
  case t when 'conceptual' then 0.3::double when 'application' then 0.7 when 'synthesis' then 1.0 else 0 end as q from k)
select learner_id, null::bigint as concept_id, level, null as bloom, completed, null::double as interest, version, errors, advanced from p
union all select learner_id, concept_id, g.level, {_BLOOM}, g.completed, case when pow(0.95, p.version - seen) >= 0.1 then pow(0.95, p.version - seen) end, null, null, null from g join p using (learner_id)""", "level interest")
add("stm_pace", lambda v: _replay(v, stateful.profile, composite=True).filter("kind = 'PACE'").select("learner_id", "version", F.col("level").alias("velocity"), F.col("text").alias("prefers"), "event"), f"""with r as ({_RUNNING.replace("{{", "{").replace("}}", "}")}),
p as (select learner_id, version, done_so_far / (minutes / 60) as velocity, 2.0 * passed / version as ratio from r where version % {stateful.PACE_EVERY} = 0)
select learner_id, version, velocity, case when ratio > 1.2 + 1e-9 then 'HARD' when ratio < 0.8 - 1e-9 then 'EASY' else 'MEDIUM' end as prefers,
  case when abs(velocity - 1) > 0.3 + 1e-9 then case when velocity > 1 then 'LEARNER_ACCELERATING' else 'LEARNER_SLOWING' end end as event from p""", "velocity")


def _notes(v):
    sink = jobs.merged_notes(_stream(v), new_folder(v.spark, "notes"))
    sink.drained(v.spark)
    parts = [df.select("attempt_id", "learner_id", "note_type", "about", "tried", F.lit(kind).alias("state")) for kind, df in sink.tables(v.spark).items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


add("stm_note_events", _notes, """select attempt_id, learner_id, case when score < 0.8 then 'MISCONCEPTION_NOTE' else 'ATOMIC_NOTE' end as note_type, case when score >= 0.8 then concat('concept ', concept_id) when err <> 'INCOMPLETE' then err end as about,
  case when score < 0.8 and err = 'INCOMPLETE' then 3 else 1 end as tried, case when score < 0.8 and err = 'INCOMPLETE' then 'aside' else 'merged' end as state from {attempts}""")
