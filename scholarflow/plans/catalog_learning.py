"""Queries over attempts, mastery, runs, notes and experiments."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..config import NOW
from ..functions import rules as R
from ..operators import analytics as A
from ..operators import experiments as X
from ..operators import mastery as M
from .registry import add

_NOW = lambda: F.lit(NOW).cast("timestamp")
STATS = """select concept_id, count(*) as n, avg(level) as avg_mastery, coalesce(stddev_samp(level), 0) as std_mastery, min(level) as min_mastery, max(level) as max_mastery,
  avg(case when level < 0.5 then 1.0 else 0.0 end) as struggle_rate from {mastery} group by concept_id"""
FOUND = f"""select concept_id, kind, avg_mastery, struggle_rate, concat('Concept ', concept_id, ' is ', kind, ': ', n, ' learners') as insight
  from (select *, case when avg_mastery < 0.4 then 'difficult' when avg_mastery > 0.8 then 'easy' end as kind from ({STATS}) s) t where kind is not null"""
ORDERED = "row_number() over (partition by learner_id, concept_id order by ts, attempt_id)"

stats = lambda v: A.concept_stats(v.mastery)
found = lambda v: A.bottlenecks(stats(v))

# --- aggregations ---------------------------------------------------------------------------------
add("agg_concept_stats", stats, STATS, "avg_mastery std_mastery min_mastery max_mastery struggle_rate")
add("agg_min_learners_gate", lambda v: A.enough_learners(v.mastery, stats(v)).select("concept_id", "n", "learners"), f"select concept_id, n, learners from ({STATS}) s, (select count(distinct learner_id) as learners from {{mastery}}) l where learners >= 5")
add("agg_bottlenecks", found, FOUND, "avg_mastery struggle_rate")
add("agg_recommendations", lambda v: A.recommendations(found(v)), f"""select concept_id, unnest(case when struggle_rate > 0.6 then ['add_examples', 'add_exercises', 'review_prerequisites'] when struggle_rate > 0.3 then ['add_exercises'] else [] end) as action from ({FOUND}) f where kind = 'difficult'""")
add("agg_predictions", lambda v: A.interventions(found(v)), f"select concept_id, unnest(['early_tutoring', 'extra_time']) as intervention from ({FOUND}) f where kind = 'difficult'")
add("join_prereq_impact", lambda v: A.prerequisite_impact(found(v), v.edges, v.mastery), f"""select e.source as concept_id, e.target as prerequisite, avg(m.level) as prerequisite_mastery, count(*) as learners
  from {{edges}} e join ({FOUND}) f on f.concept_id = e.source and f.kind = 'difficult' join {{mastery}} m on m.concept_id = e.target where e.rel_type = 'REQUIRES' group by 1, 2""", "prerequisite_mastery")
add("agg_learner_graphs", lambda v: A.learner_graphs(v.mastery), "select learner_id, count(*) as n_concepts, string_agg(cast(concept_id as varchar), ',' order by concept_id) as concepts from {mastery} group by 1")
add("agg_avg_mastery", lambda v: A.avg_mastery(v.mastery), "select learner_id, avg(level) as avg_mastery from {mastery} group by 1", "avg_mastery")
add("agg_run_summary", lambda v: A.run_summary(v.runs), "select count(*) as runs, 100 * avg(case when status = 'success' then 1.0 else 0.0 end) as success_pct, avg(duration) filter (status = 'success' and mode = 'real') as mean_real_duration from {runs}", "success_pct mean_real_duration")
add("agg_run_by_type_mode", lambda v: A.run_by_kind_mode(v.runs), "select kind, mode, avg(duration) as mean_duration, count(*) as runs from {runs} where status = 'success' group by 1, 2", "mean_duration")
add("agg_run_latency", lambda v: A.run_latency(v.runs), "select kind, mode, avg(ke_ms) / 1000 as ke_s, avg(profiler_ms) / 1000 as profiler_s, avg(tutor_ms) / 1000 as tutor_s from {runs} group by 1, 2", "ke_s profiler_s tutor_s")
add("agg_agent_calls", lambda v: A.agent_calls(v.calls), "select agent, count(*) as calls, avg(case when success then 1.0 else 0.0 end) as success_rate, avg(latency_ms) as avg_latency, min(latency_ms) as min_latency, max(latency_ms) as max_latency from {calls} group by 1", "success_rate avg_latency min_latency max_latency")
add("agg_agent_health", lambda v: A.agent_health(v.calls, F.lit("1998-06-01").cast("timestamp")), """select *, case when errors * 2 > calls then 'down' when errors > 0 then 'degraded' else 'healthy' end as status from (
  select agent, count(*) as calls, count(*) filter (not success) as errors, avg(latency_ms) as latency from {calls} where called_at > timestamp '1998-05-31' and called_at <= timestamp '1998-06-01' group by 1) x""", "latency")
add("agg_cohort_compare", lambda v: A.cohort_compare(v.outcomes), "select cohort, count(*) as n, avg(post) as avg_post, avg(case when post >= 50 then 1.0 else 0.0 end) as completion_rate from {outcomes} group by 1", "avg_post completion_rate")
add("agg_roster", lambda v: A.roster(v.attempts, _NOW()), f"""select *, case when last_active >= timestamp '{NOW}' - interval 7 day then 'active' else 'inactive' end as status from (
  select learner_id, max(ts) as last_active, count(distinct concept_id) as concepts, avg(score) as progress from {{attempts}} group by 1) x""", "progress", "last_active")
add("agg_system_totals", lambda v: A.system_totals(v.mastery, stats(v)), f"""select learners, concepts, avg_success, difficult, easy from (select count(distinct learner_id) as learners, count(distinct concept_id) as concepts, avg(level) as avg_success from {{mastery}}) a,
  (select count(*) filter (avg_mastery < 0.4) as difficult, count(*) filter (avg_mastery > 0.8) as easy from ({STATS}) s) b""", "avg_success")
PATTERNS = """select learner_id, concept_id, err, count(*) as frequency, max(ts) as last_seen, arg_max(case when score < 0.2 then 'HIGH' when score < 0.5 then 'MEDIUM' else 'LOW' end, (ts, attempt_id)) as severity from {attempts} group by 1, 2, 3"""
add("agg_error_patterns", lambda v: A.error_patterns(v.attempts), PATTERNS, times="last_seen")
add("agg_misconception_flags", lambda v: A.misconception_flags(A.error_patterns(v.attempts)), f"select learner_id, concept_id, bool_or(severity = 'HIGH') as severe, bool_or(err = 'CONCEPTUAL') as conceptual, bool_or(frequency >= 3) as persistent from ({PATTERNS}) p group by 1, 2")
add("agg_error_distribution", lambda v: A.error_distribution(v.attempts), "select learner_id, count(*) filter (err = 'CARELESS') as \"CARELESS\", count(*) filter (err = 'CONCEPTUAL') as \"CONCEPTUAL\", count(*) filter (err = 'INCOMPLETE') as \"INCOMPLETE\" from {attempts} group by 1")
ARMS = "select concept_id, count(*) as pulls, sum(score) as total_reward, avg(score) as avg_reward from {attempts} group by 1"
add("agg_bandit_stats", lambda v: A.bandit_stats(v.attempts), ARMS, "total_reward avg_reward")
_FEATURES = lambda: [F.lit(1.0), F.col("difficulty") / 5.0, F.col("score")]
add("agg_linucb_arms", lambda v: A.linucb_arms(v.attempts, _FEATURES()), """with x as (select concept_id, score, [1.0::double, difficulty / 5.0, score] as f from {attempts}),
c as (select concept_id, i - 1 as row, j - 1 as col, f[i] * f[j] as v from x, unnest(range(1, 4)) as a(i), unnest(range(1, 4)) as b(j) union all select concept_id, i - 1, -1, score * f[i] from x, unnest(range(1, 4)) as a(i))
select concept_id, cast(r as int) as "row", cast(c as int) as col, v + case when r = c then 1 else 0 end as v from (select concept_id, "row" as r, col as c, sum(v) as v from c group by 1, 2, 3) x""", "v")
add("agg_weighted_merge", lambda v: A.weighted_merge(v.snapshots, "concept_id", "quantity", "confidence"), "select concept_id, case when sum(confidence) > 0 then sum(quantity * confidence) / sum(confidence) else avg(quantity) end as merged from {snapshots} group by 1", "merged")
add("agg_representative", lambda v: A.representative(v.concepts, "name"), "select name, arg_max(concept_id, (length(description), -concept_id)) as representative, array_to_string(list_sort(list(distinct kind)), ',') as tags, count(*) as members from {concepts} group by 1")
_usages = lambda v: v.snapshots.select(F.col("supp_id").alias("domain"), F.concat(F.lit("ctx "), (F.col("concept_id") % 50).cast("string")).alias("context"), "doc_id", F.col("uploaded_at").alias("ts"))
PENDING = """select *, recent >= 5 or (recent >= 2 and docs >= 2) as needs_review from (select supp_id as domain, concat('ctx ', concept_id % 50) as context, count(*) as total, count(*) filter (uploaded_at >= timestamp '1998-06-01' - interval 7 day) as recent,
  count(distinct doc_id) as docs, min(uploaded_at) as first_seen, max(uploaded_at) as last_seen from {snapshots} group by 1, 2) x"""
add("agg_context_pending", lambda v: A.context_pending(_usages(v), F.lit("1998-06-01").cast("timestamp")), PENDING, times="first_seen last_seen")
add("agg_unmapped", lambda v: _usages(v).groupBy("context").agg(F.count(F.lit(1)).alias("n")).filter("n >= 2"), "select concat('ctx ', concept_id % 50) as context, count(*) as n from {snapshots} group by 1 having count(*) >= 2")
add("agg_top_contexts", lambda v: A.top_per_group(_usages(v).groupBy("domain", "context").agg(F.count(F.lit(1)).alias("n")), "domain", [F.desc("n"), F.col("context")], 5),
    "select * from (select domain, context, n, cast(row_number() over (partition by domain order by n desc, context) as int) as rank from (select supp_id as domain, concat('ctx ', concept_id % 50) as context, count(*) as n from {snapshots} group by 1, 2) x) y where rank <= 5")
add("agg_note_quality", lambda v: A.note_quality(v.notes), "select learner_id, count(*) as concepts, avg(n) as notes_per_concept from (select learner_id, concept_id, count(*) as n from {notes} group by 1, 2) x group by 1", "notes_per_concept")
add("agg_artifact_state", lambda v: A.artifact_state(v.notes), """select learner_id, count(*) filter (note_type = 'ATOMIC_NOTE') as atomic_note, count(*) filter (note_type = 'MISCONCEPTION_NOTE') as misconception_note, count(*) filter (note_type = 'SUMMARY_NOTE') as summary_note,
  cast(sum(len(string_split(content, ' '))) as bigint) as words, max(created_at) as last_created from {notes} group by 1""", times="last_created")
_errors = lambda v: v.calls.select(F.concat(F.lit("sev"), (F.col("run_id") % 3).cast("string")).alias("severity"), (F.col("run_id") % 2 == 0).alias("remediated"), "success", (F.col("latency_ms") / 100).alias("hours"))
add("agg_remediation", lambda v: A.remediation(_errors(v)), """select concat('sev', run_id % 3) as severity, count(*) as errors, avg(case when run_id % 2 = 0 then 1.0 else 0.0 end) as remediated_share,
  avg(case when success then 1.0 else 0.0 end) filter (run_id % 2 = 0) as success_share, avg(latency_ms / 100) as mean_hours from {calls} group by 1""", "remediated_share success_share mean_hours")
_answers = lambda v: v.attempts.select("learner_id", (F.col("attempt_id") % 4).alias("answer"), (F.col("attempt_id") % 3).alias("correct_answer"), F.col("difficulty").alias("points"))
add("agg_test_grade", lambda v: A.grade_tests(_answers(v)), "select learner_id, cast(sum(case when attempt_id % 4 = attempt_id % 3 then difficulty else 0 end) as bigint) as points, sum(case when attempt_id % 4 = attempt_id % 3 then difficulty else 0 end) / sum(difficulty) as score from {attempts} group by 1", "score")
_criteria = "select * from (values ('REMEMBER', 0.1), ('UNDERSTAND', 0.2), ('APPLY', 0.3), ('ANALYZE', 0.2), ('EVALUATE', 0.2)) as t(criterion, weight)"
add("agg_rubric_score", lambda v: A.rubric_score(v.attempts.groupBy("learner_id", F.col("bloom").alias("criterion")).agg(F.avg("score").alias("level")), v.spark.sql(_criteria)), f"""select *, case when score >= 0.8 then 'excellent' when score >= 0.6 then 'good' when score >= 0.4 then 'fair' else 'poor' end as band from (
  select learner_id, sum(weight * level) as score from (select learner_id, bloom as criterion, avg(score) as level from {{attempts}} group by 1, 2) l join ({_criteria}) w using (criterion) group by 1) x""", "score")

# --- experiments ----------------------------------------------------------------------------------
GAINS = """select learner_id, cohort, condition, case when pre >= 99.9 then 0 else least(1.0, greatest(-1.0, (post - pre) / (100 - pre))) end as gain,
  case when post < 1 then 0 else greatest(0.0, (post - retention) / post) end as decay, case when pre <= 30 then 'low' when pre <= 70 then 'medium' else 'high' end as band from {outcomes}"""
gains = lambda v: X.gains(v.outcomes)
add("exp_learning_gain", lambda v: gains(v).select("learner_id", "gain"), f"select learner_id, gain from ({GAINS}) g", "gain")
add("exp_retention_decay", lambda v: gains(v).select("learner_id", "decay"), f"select learner_id, decay from ({GAINS}) g", "decay")
add("exp_cohens_d", lambda v: X.cohens_d(gains(v), "gain", F.col("cohort") == "treatment"), f"""with s as (select avg(gain) filter (cohort = 'treatment') as mean_t, avg(gain) filter (cohort <> 'treatment') as mean_c, var_samp(gain) filter (cohort = 'treatment') as var_t, var_samp(gain) filter (cohort <> 'treatment') as var_c,
  count(*) filter (cohort = 'treatment') as n_t, count(*) filter (cohort <> 'treatment') as n_c from ({GAINS}) g),
 d as (select mean_t, mean_c, n_t, n_c, sqrt(((n_t - 1) * var_t + (n_c - 1) * var_c) / (n_t + n_c - 2)) as pooled_sd from s)
 select *, (mean_t - mean_c) / pooled_sd as cohens_d, case when abs((mean_t - mean_c) / pooled_sd) < 0.2 then 'negligible' when abs((mean_t - mean_c) / pooled_sd) < 0.5 then 'small' when abs((mean_t - mean_c) / pooled_sd) < 0.8 then 'medium' else 'large' end as interpretation from d""", "mean_t mean_c pooled_sd cohens_d")
_t = " ".join(f"when n - 1 <= {k} then {q}" for k, q in sorted(X.T975.items()))
add("exp_confidence_interval", lambda v: X.confidence_interval(gains(v), "gain", ["condition"]), f"""select condition, n, mean, case when n >= 2 then mean - t * sd / sqrt(n) end as low, case when n >= 2 then mean + t * sd / sqrt(n) end as high from (
  select *, case {_t} else 1.96 end as t from (select condition, count(gain) as n, avg(gain) as mean, stddev_samp(gain) as sd from ({GAINS}) g group by 1) x) y""", "mean low high")
ABLATION = f"""select condition, n, mean_gain, mean_decay, case when sqrt(((n0 - 1) * v0 + (n - 1) * v) / (n0 + n - 2)) > 0 then (m0 - mean_gain) / sqrt(((n0 - 1) * v0 + (n - 1) * v) / (n0 + n - 2)) else 0 end as d_full from (
  select condition, avg(gain) as mean_gain, avg(decay) as mean_decay, var_samp(gain) as v, count(*) as n from ({GAINS}) g group by 1) a, (select avg(gain) as m0, var_samp(gain) as v0, count(*) as n0 from ({GAINS}) g where condition = 0) b"""
add("exp_ablation_table", lambda v: X.ablation_table(gains(v)), ABLATION, "mean_gain mean_decay d_full")
add("exp_component_contribution", lambda v: X.component_contribution(X.ablation_table(gains(v))), f"select a.condition, a.d_full as delta_d, 100 * a.d_full / b.d_full as share_pct from ({ABLATION}) a, ({ABLATION}) b where b.condition = 4 and a.condition not in (0, 4)", "delta_d share_pct")
add("exp_bootstrap_ci", lambda v: X.bootstrap_ci(gains(v), "gain", F.col("cohort") == "treatment"))
add("exp_time_to_mastery", lambda v: X.time_to_mastery(v.attempts), """select learner_id, cast(min(n) as int) as attempts_needed from (select learner_id, row_number() over w as n, avg(score) over (partition by learner_id order by ts, attempt_id rows unbounded preceding) as mean from {attempts} window w as (partition by learner_id order by ts, attempt_id)) x where mean >= 0.7 group by 1""")
add("exp_retention_rate", lambda v: X.retention_rate(v.outcomes), "select condition, 100 * avg(retention) / avg(post) as retention_pct from {outcomes} group by 1", "retention_pct")
add("exp_engagement", lambda v: X.engagement(v.attempts), "select avg(case when c >= 15 then 1.0 else 0.0 end) as completion_rate, avg(case when n < 60 then 1.0 else 0.0 end) as dropout_rate from (select learner_id, count(distinct concept_id) as c, count(*) as n from {attempts} group by 1) x", "completion_rate dropout_rate")
ASSIGNED = "select learner_id, case when ((learner_id * 2654435761) % 4294967296 // 65536) % 2 = 0 then 'treatment' else 'control' end as cohort from (select distinct learner_id from {attempts}) l"
_assigned = lambda v: X.assign(v.attempts.select("learner_id").distinct())
add("exp_assign", _assigned, ASSIGNED)
_flags = "select * from (values ('treatment', true, true), ('control', false, false)) as t(cohort, use_graph, use_bandit)"
add("exp_cohort_config", lambda v: _assigned(v).join(F.broadcast(v.spark.sql(_flags)), "cohort"), f"select a.*, use_graph, use_bandit from ({ASSIGNED}) a join ({_flags}) f using (cohort)")
_log = lambda v: v.attempts.select("learner_id", "ts", F.when(F.col("attempt_id") % 5 < 3, "treatment").otherwise("control").alias("shown"), F.col("score").alias("outcome"))
add("exp_exposure_itt", lambda v: X.exposure(_assigned(v), _log(v)), f"""select cohort, count(*) as assigned, avg(outcome) as itt, avg(outcome) filter (shown = cohort) as as_treated from ({ASSIGNED}) a left join (
  select learner_id, arg_min(shown, (ts, shown)) as shown, avg(outcome) as outcome from (select learner_id, ts, case when attempt_id % 5 < 3 then 'treatment' else 'control' end as shown, score as outcome from {{attempts}}) l group by 1) e using (learner_id) group by 1""", "itt as_treated")
add("exp_assign_dedup", lambda v: M.latest(v.attempts.select("learner_id", "content_type", "ts", "attempt_id"), ["learner_id", "content_type"], [F.col("ts"), F.col("attempt_id")]).select("learner_id", "content_type", "attempt_id"), "select learner_id, content_type, arg_min(attempt_id, (ts, attempt_id)) as attempt_id from {attempts} group by 1, 2")
_vectors = "select * from (values ('even', 0.34, 0.33, 0.33), ('fit', 0.6, 0.2, 0.2), ('goal', 0.2, 0.2, 0.6), ('flow', 0.2, 0.6, 0.2)) as t(vector, w1, w2, w3)"
_quality = lambda v: v.attempts.groupBy("learner_id").agg(F.avg("score").alias("feasibility"), F.avg((F.col("difficulty") <= 3).cast("double")).alias("coherence"), F.avg((F.col("bloom") == "APPLY").cast("double")).alias("relevance"))
QUALITY = "select learner_id, avg(score) as feasibility, avg(case when difficulty <= 3 then 1.0 else 0.0 end) as coherence, avg(case when bloom = 'APPLY' then 1.0 else 0.0 end) as relevance from {attempts} group by 1"
SWEEP = f"select vector, avg(w1 * feasibility + w2 * coherence + w3 * relevance) as mean_quality, coalesce(stddev_samp(w1 * feasibility + w2 * coherence + w3 * relevance), 0) as sd_quality from ({QUALITY}) q, ({_vectors}) w group by 1"
add("exp_weight_sweep", lambda v: X.weight_sweep(_quality(v), v.spark.sql(_vectors)), SWEEP, "mean_quality sd_quality")
add("exp_path_quality", lambda v: _quality(v).select("learner_id", ((F.col("feasibility") + F.col("coherence") + F.col("relevance")) / 3).alias("quality")), f"select learner_id, (feasibility + coherence + relevance) / 3 as quality from ({QUALITY}) q", "quality")
add("agg_strata_rollup", lambda v: A.strata_rollup(gains(v)), f"select band, condition, count(*) as n, avg(gain) as mean_gain from ({GAINS}) g group by cube (band, condition)", "mean_gain")

# --- ordered attempts -----------------------------------------------------------------------------
FOLD = """select learner_id, concept_id, list({{'m': 0.0::double, 's': score, 'j': case when score >= 0.9 and bloom in ('UNDERSTAND', 'APPLY', 'ANALYZE') then 0.05 when score < 0.4 and bloom in ('ANALYZE', 'EVALUATE', 'CREATE') then -0.05 else 0 end::double}} order by ts, attempt_id) as a from {attempts} group by 1, 2"""
add("win_ewma_mastery", lambda v: M.ewma(v.attempts), f"""select learner_id, concept_id, list_reduce(list_prepend({{{{'m': 0.0::double, 's': 0.0::double, 'j': 0.0::double}}}}, a), lambda x, y: {{{{'m': least(1.0, greatest(0.0, x.m * 0.7 + y.s * 0.3 + y.j)), 's': 0.0, 'j': 0.0}}}}).m as mastery, cast(len(a) as int) as attempts from ({FOLD}) f""", "mastery")
BKT = """with o as (select learner_id, concept_id, list(case when score >= 0.6 then 2.0::double else 3.0::double end order by ts, attempt_id) as a from {attempts} group by 1, 2)
select learner_id, concept_id, list_reduce(list_prepend(0.3::double, a), lambda p, y: (case when y = 2 then p * 0.9 / (p * 0.9 + (1 - p) * 0.25) else p * 0.1 / (p * 0.1 + (1 - p) * 0.75) end) * 0.9 + 0.1) as p_known from o"""
add("win_bkt_mastery", lambda v: M.bkt(v.attempts), BKT, "p_known")
add("win_mastery_trend", lambda v: M.trend(v.attempts).drop("recent"), """select learner_id, concept_id, attempts, current, floor((case when attempts >= 2 then (current - first) / attempts else current end)::double * 1000 + 0.500001) / 1000 as velocity,
  case when attempts < 3 then 'INITIAL' when recent >= 0.8 then 'MASTERING' when recent >= 0.5 then 'PROGRESSING' else 'STRUGGLING' end as trend from (
  select learner_id, concept_id, count(*) as attempts, arg_min(score, (ts, attempt_id)) as first, arg_max(score, (ts, attempt_id)) as current, arg_max(recent, (ts, attempt_id)) as recent from (
    select *, avg(score) over (partition by learner_id, concept_id order by ts, attempt_id rows between 2 preceding and current row) as recent from {attempts}) r group by 1, 2) x""", "current velocity")
add("win_learning_velocity", lambda v: M.learning_velocity(v.attempts, 5.0 + F.col("difficulty")), "select learner_id, concept_id, case when count(*) < 2 then 1.0 else (arg_max(score, (ts, attempt_id)) - arg_min(score, (ts, attempt_id))) / greatest(0.1, sum(5.0 + difficulty) / 60) end as velocity from {attempts} group by 1, 2", "velocity")
add("win_history_lkt", lambda v: M.history_text(v.attempts), """select learner_id, concat('[CLS] ', string_agg(concat('concept ', concept_id, case when score >= 0.6 then ' [CORRECT]' else ' [INCORRECT]' end), ' \n ' order by r desc)) as history from (
  select *, row_number() over (partition by learner_id order by ts desc, attempt_id desc) as r from {attempts}) x where r <= 10 group by 1""")
add("win_keep_last_n", lambda v: M.keep_last(v.attempts.select("learner_id", "attempt_id", "ts"), "learner_id", [F.desc("ts"), F.desc("attempt_id")], 20).drop("ts"), "select * from (select learner_id, attempt_id, cast(row_number() over (partition by learner_id order by ts desc, attempt_id desc) as int) as rank from {attempts}) x where rank <= 20")
add("win_profile_change", lambda v: M.profile_changes(v.attempts), "select learner_id, attempt_id, mean, before from (select *, lag(mean) over (partition by learner_id order by ts, attempt_id) as before from (select *, avg(score) over (partition by learner_id order by ts, attempt_id rows unbounded preceding) as mean from {attempts}) a) b where abs(mean - before) > 0.1", "mean before")
add("win_style_mismatch", lambda v: M.style_mismatch(v.attempts), "select learner_id, concept_id, count(*) as failures from {attempts} where score < 0.4 group by 1, 2 having count(*) >= 2 and count(distinct content_type) = 1")
SESSIONS = """select learner_id, session, min(ts) as started, max(ts) as ended, count(*) as events, count(distinct concept_id) as concepts from (select *, cast(sum(new) over (partition by learner_id order by ts, attempt_id rows unbounded preceding) as bigint) as session from (
  select *, case when lag(ts) over w is null or floor(epoch(ts)) - floor(epoch(lag(ts) over w)) > 43200 then 1 else 0 end as new from {attempts} window w as (partition by learner_id order by ts, attempt_id)) a) b group by 1, 2"""
add("win_session_episode", lambda v: M.sessions(v.attempts), SESSIONS, times="started ended")
add("win_concept_episode", lambda v: M.concept_episodes(v.attempts), "select learner_id, concept_id, min(ts) as first_seen, count(*) - 1 as revisits, arg_max(bloom, (ts, attempt_id)) as level, arg_max(score, (ts, attempt_id)) as last_score from {attempts} group by 1, 2", "last_score", "first_seen")
add("win_dialogue_phase", lambda v: M.dialogue_phases(v.dialogue), """with o as (select conv_id, list({{'p': 0, 't': 0, 'r': case when is_correct then 1 else 0 end}} order by turn) as a from {dialogue} group by 1),
f as (select conv_id, cast(len(a) as int) as turns, list_reduce(list_prepend({{'p': 0, 't': 0, 'r': 0}}, a), lambda s, x: case when case s.p when 0 then s.t + 1 >= 2 when 1 then s.r + x.r >= 2 or s.t + 1 >= 3 when 2 then s.t + 1 >= 3 else false end then {{'p': s.p + 1, 't': 0, 'r': 0}} else {{'p': s.p, 't': s.t + 1, 'r': s.r + x.r}} end).p as p from o)
select conv_id, turns, ['EXPLANATION', 'QUESTIONING', 'PRACTICE', 'ASSESSMENT'][p + 1] as phase from f""")
add("win_interest_decay", lambda v: M.interest_decay(v.attempts), "select learner_id, concept_id, pow(0.95, min(later)) as weight from (select learner_id, concept_id, count(*) over (partition by learner_id) - row_number() over (partition by learner_id order by ts, attempt_id) as later from {attempts}) x group by 1, 2 having pow(0.95, min(later)) >= 0.1", "weight")
add("win_recent_runs", lambda v: v.runs.orderBy(F.desc("started_at"), F.desc("run_id")).limit(10).select("run_id", "kind", "mode", "status"), "select run_id, kind, mode, status from {runs} order by started_at desc, run_id desc limit 10")

# --- sources, filters, scalar rules ---------------------------------------------------------------
add("src_progress", lambda v: v.mastery, "select * from {mastery}", "level")
add("src_evaluations", lambda v: v.attempts.select("attempt_id", "learner_id", "concept_id", "score", "ts"), "select attempt_id, learner_id, concept_id, score, ts from {attempts}", "score", "ts")
add("src_session_logs", lambda v: v.events.select("event_id", F.from_json("props", "k int")["k"].alias("k")).groupBy("k").agg(F.count(F.lit(1)).alias("n")), "select cast(json_extract_string(props, '$.k') as int) as k, count(*) as n from events group by 1")
add("src_events", lambda v: v.events.orderBy(F.desc("ts"), F.desc("event_id")).limit(100).select("event_id", "event_type"), "select event_id, event_type from events order by ts desc, event_id desc limit 100")
add("src_notes", lambda v: v.notes.select("note_id", "learner_id", "concept_id", "note_type"), "select note_id, learner_id, concept_id, note_type from {notes}")
add("flt_progress_history", lambda v: v.attempts.filter("learner_id = 7 and concept_id = 3").select("attempt_id", "score", "ts"), "select attempt_id, score, ts from {attempts} where learner_id = 7 and concept_id = 3", "score", "ts")
add("flt_learner_evals", lambda v: v.attempts.filter("learner_id = 11").select("attempt_id", "concept_id", "score"), "select attempt_id, concept_id, score from {attempts} where learner_id = 11", "score")
add("flt_valid_ids", lambda v: v.pages.filter(F.trim("url") != "").filter(~F.col("url").rlike("^[a-zA-Z0-9_-]+$")).select("page_id"), "select page_id from pages where trim(url) <> '' and not regexp_full_match(url, '[a-zA-Z0-9_-]+')")
add("flt_topic", lambda v: v.concepts.filter(F.contains(F.lower("name"), F.lit("gear"))).select("concept_id", "name"), "select concept_id, name from {concepts} where contains(lower(name), 'gear')")
add("flt_live_docs", lambda v: v.snapshots.filter("status = 'COMMITTED'").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")), "select doc_id, count(*) as n from {snapshots} where status = 'COMMITTED' group by 1")
add("flt_staleness", lambda v: v.attempts.filter(F.unix_timestamp(_NOW()) - F.unix_timestamp("ts") > 3600 * 24 * 20).groupBy("learner_id").agg(F.count(F.lit(1)).alias("stale")), f"select learner_id, count(*) as stale from {{attempts}} where epoch(timestamp '{NOW}') - floor(epoch(ts)) > 1728000 group by 1")
add("prj_note_type_simple", lambda v: v.attempts.select("attempt_id", R.note_type_simple(F.col("score")).alias("note_type")), "select attempt_id, case when score < 0.8 then 'MISCONCEPTION_NOTE' else 'ATOMIC_NOTE' end as note_type from {attempts}")
add("prj_note_type", lambda v: v.attempts.select("attempt_id", R.note_type(F.col("score"), F.col("difficulty") == 5, F.col("err")).alias("note_type")), "select attempt_id, case when score < 0.5 and (difficulty = 5 or err = 'CONCEPTUAL') then 'MISCONCEPTION_NOTE' when score >= 0.75 then 'ATOMIC_NOTE' else 'SUMMARY_NOTE' end as note_type from {attempts}")
add("prj_recent_summary", lambda v: v.notes.select("note_id", F.substring("content", 1, 20).alias("preview")), "select note_id, substring(content, 1, 20) as preview from {notes}")
add("prj_content_type", lambda v: v.attempts.select("attempt_id", R.content_type(F.col("difficulty"), F.when(F.col("concept_id") % 2 == 0, "VISUAL").otherwise("READING")).alias("kind")), "select attempt_id, case when difficulty <= 2 then 'TUTORIAL' when concept_id % 2 = 0 then 'VIDEO' else 'ARTICLE' end as kind from {attempts}")
DECISION = "case when score >= 0.9 - ease - boost then 'MASTERED' when score >= 0.8 - ease then 'PROCEED' when score >= 0.6 - ease then 'ALTERNATE' when err = 'CONCEPTUAL' then 'REMEDIATE' else 'RETRY' end"
_mean = lambda: F.col("score") * 0.5 + 0.3
DECIDED = f"select *, {DECISION} as decision from (select *, case when difficulty >= 4 then 0.05 else 0.0 end as ease, case when score * 0.5 + 0.3 >= 0.7 then 0.03 else 0.0 end as boost from {{attempts}}) a"
_decided = lambda v: v.attempts.withColumn("decision", R.path_decision(F.col("score"), _mean(), F.col("err"), F.col("difficulty")))
add("mth_path_decision", lambda v: _decided(v).select("attempt_id", "decision"), f"select attempt_id, decision from ({DECIDED}) d")
add("mth_decision_table", lambda v: v.attempts.select("attempt_id", R.decision_table(F.col("score"), F.col("err"), F.col("difficulty") == 5, F.col("err") == "CONCEPTUAL", F.col("difficulty") == 4, F.col("content_type") == "VIDEO").alias("decision")), """select attempt_id, case when score >= 0.9 and difficulty <> 5 then 'MASTERED' when score >= 0.8 and err <> 'CONCEPTUAL' then 'PROCEED' when score >= 0.6 and err = 'CARELESS' then 'PROCEED'
  when score >= 0.6 and err = 'CONCEPTUAL' then case when content_type = 'VIDEO' then 'ALTERNATE' else 'RETRY' end when score < 0.6 and (difficulty = 4 or err = 'CONCEPTUAL') then 'REMEDIATE' when score < 0.4 then 'REMEDIATE' else 'RETRY' end as decision from {attempts}""")
_suggest = " ".join(f"when '{k}' then '{t}'" for k, t in R.SUGGESTIONS.items())
add("mth_decision_metadata", lambda v: _decided(v).select("attempt_id", R.suggestion(F.col("decision")).alias("suggestion"), R.decision_confidence(F.col("decision"), _mean()).alias("confidence"), F.col("decision").isin("ALTERNATE", "REMEDIATE").alias("replan")), f"select attempt_id, case decision {_suggest} end as suggestion, case when decision in ('MASTERED', 'PROCEED') then least(1.0, score * 0.5 + 0.3 + 0.1) else 0.6 end as confidence, decision in ('ALTERNATE', 'REMEDIATE') as replan from ({DECIDED}) d", "confidence")
add("mth_reward", lambda v: v.attempts.select("attempt_id", R.reward(F.col("score"), F.col("score") >= 0.6, F.when(F.col("difficulty") <= 3, F.col("difficulty") / 10.0)).alias("reward")), "select attempt_id, 0.6 * score + 0.4 * case when score >= 0.6 then 1.0 else 0.0 end - 0.5 * case when difficulty <= 3 then difficulty / 10.0 when score >= 0.6 then 0.0 else 0.2 end as reward from {attempts}", "reward")
add("mth_gate_probability", lambda v: v.attempts.select("attempt_id", R.gate_probability(F.col("score")).alias("p")), "select attempt_id, least(1.0, score / 0.8) as p from {attempts}", "p")
add("mth_initial_mastery", lambda v: v.concepts.select("concept_id", R.initial_mastery(F.col("difficulty")).alias("m")), "select concept_id, greatest(0.1, 0.5 - difficulty * 0.08) as m from {concepts}", "m")
add("mth_time_estimate", lambda v: v.concepts.select("concept_id", R.hours(F.col("difficulty"), F.lit(1.5)).alias("hours")), "select concept_id, 0.5 * [0.5, 0.8, 1.0, 1.5, 2.0][difficulty] / 1.5 as hours from {concepts}", "hours")
add("mth_bloom_level", lambda v: v.attempts.select("attempt_id", R.bloom_level(F.col("score"), F.col("difficulty"), F.col("qtype")).alias("level")), """select attempt_id, ['REMEMBER', 'UNDERSTAND', 'APPLY', 'ANALYZE', 'EVALUATE', 'CREATE'][cast(round_even(least(6.0, greatest(1.0, 0.60::double * b + 0.25::double * (b + s) + 0.15::double * (b + q))), 0) as int)] as level from (
  select attempt_id, case when score < 0.2 then 1 when score < 0.4 then 2 when score < 0.6 then 3 when score < 0.8 then 4 when score < 0.9 then 5 else 6 end as b, case when difficulty >= 4 then -0.5::double when difficulty <= 2 then 0.5::double else 0::double end as s,
  case qtype when 'conceptual' then 0.3::double when 'application' then 0.7::double when 'synthesis' then 1.0::double else 0::double end as q from {attempts}) x""")
add("mth_pacing", lambda v: v.concepts.select("concept_id", R.pacing(F.col("time_estimate"), F.lit(100), F.col("difficulty") - 1).alias("pacing")), "select concept_id, case when difficulty - 1 = 0 then 'NO_PATH' when time_estimate / 100.0 > 0.9 then 'AGGRESSIVE' when time_estimate / 100.0 > 0.7 then 'MODERATE' else 'RELAXED' end as pacing from {concepts}")
add("mth_answer_score", lambda v: v.attempts.select("attempt_id", *[c.alias(n) for c, n in zip(R.answer_score(F.col("score"), F.col("difficulty") / 5.0, F.lit(0.5), F.when(F.col("concept_id") > 0, "x").otherwise(" ")), ("score", "confidence"), strict=True)]), """select attempt_id, case when concept_id = 0 then 0.0 else least(1.0, greatest(0.0, 0.4 * score + 0.5 * (difficulty / 5.0) + 0.05)) end as score,
  case when concept_id = 0 then 0.9 else least(1.0, greatest(0.3, (1 - abs(score - difficulty / 5.0)) * 0.7 + 0.15)) end as confidence from {attempts}""", "score confidence")
add("mth_cosine", lambda v: v.embeddings.select("vec_id", R.cosine(F.col("embedding"), F.reverse("embedding")).alias("cos")), "select vec_id, list_cosine_similarity(embedding::double[], list_reverse(embedding)::double[]) as cos from embeddings", "cos")
