"""Queries over the concept graph, planning, provenance and documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import rules as R
from ..operators import analytics as A
from ..operators import graph as G
from ..operators import planning as P
from ..operators import text as D
from ..operators.resolve import topk_similar
from .registry import add

LIST = "coalesce(array_to_string(list_sort(list(distinct target) filter (rel_type = '{}')), ','), '')"

# --- graph ----------------------------------------------------------------------------------------
_need = "select distinct source, target from {edges} where rel_type = 'REQUIRES'"
add("grf_prereq_closure", lambda v: G.prerequisite_closure(v.edges), f"""with n as ({_need}), a as (select source as concept_id, target as prerequisite from n), b as (select distinct a.concept_id, n.target as prerequisite from a join n on n.source = a.prerequisite), c as (select distinct b.concept_id, n.target as prerequisite from b join n on n.source = b.prerequisite)
select concept_id, prerequisite, min(depth) as depth from (select *, 1 as depth from a union all select *, 2 from b union all select *, 3 from c) x group by 1, 2""")
add("grf_alternatives", lambda v: G.alternatives(v.edges), "select source as concept_id, target as alternative from {edges} where rel_type = 'SIMILAR_TO' union select target, source from {edges} where rel_type = 'SIMILAR_TO'")
add("grf_reachable", lambda v: G.reachable(v.edges), "select * from (select source, target, cast(row_number() over (partition by source order by target) as int) as rank from (select distinct source, target from {edges} where rel_type in ('NEXT', 'IS_PREREQUISITE_OF', 'SIMILAR_TO')) e) x where rank <= 5")
_chosen = lambda v: v.concepts.filter("difficulty <= 2")
add("join_induced_edges", lambda v: G.induced(v.edges, _chosen(v)), "select * from {edges} where source in (select concept_id from {concepts} where difficulty <= 2) and target in (select concept_id from {concepts} where difficulty <= 2)", "weight")
add("join_touching_edges", lambda v: G.touching(v.edges, _chosen(v)), "select distinct * from {edges} where source in (select concept_id from {concepts} where difficulty <= 2) or target in (select concept_id from {concepts} where difficulty <= 2)", "weight")
add("grf_relationship_map", lambda v: G.relationship_map(v.edges), "select rel_type, source, count(*) as n, array_to_string(list_sort(list(distinct target)), ',') as targets from {edges} group by 1, 2")
add("join_concept_context", lambda v: G.concept_context(v.concepts, v.edges), f"""select c.concept_id, c.name, coalesce(prerequisites, '') as prerequisites, coalesce(similar_, '') as "similar", coalesce(remedies, '') as remedies from {{concepts}} c left join (
  select source, {LIST.format('REQUIRES')} as prerequisites, {LIST.format('SIMILAR_TO')} as similar_, {LIST.format('REMEDIATES')} as remedies from {{edges}} group by 1) e on e.source = c.concept_id""")
add("join_personal_subgraph", lambda v: G.personal_subgraph(v.mastery, v.edges), "select learner_id, cast(concept_id as bigint) as concept_id from {mastery} union select learner_id, target from {mastery} m join {edges} e on e.source = m.concept_id")
add("agg_node_inventory", lambda v: G.node_inventory(v.concepts), "select kind, count(*) as nodes from {concepts} group by 1")
add("agg_rel_inventory", lambda v: G.relation_inventory(v.edges), "select rel_type, count(*) as edges, avg(weight) as avg_weight from {edges} group by 1", "avg_weight")
add("agg_centrality", lambda v: G.centrality(v.edges), "select concept_id, count(*) as degree from (select source as concept_id from {edges} where rel_type = 'REQUIRES' union all select target from {edges} where rel_type = 'REQUIRES') x group by 1 order by degree desc, concept_id limit 50")
add("agg_graph_health", lambda v: G.health(v.concepts, v.edges), """with x as (select (select count(*) from {concepts}) as nodes, (select count(*) from {edges}) as edges_, (select count(*) from {concepts} where concept_id not in (select source from {edges} union all select target from {edges})) as orphans),
y as (select nodes, edges_ as edges, orphans, 2 * edges_ / nodes as avg_degree, 100 * orphans / nodes as orphan_pct from x), z as (select *, case when nodes > 0 then 20 else 0 end + case when edges > 0 then 20 else 0 end + case when orphan_pct < 5 then 30 else 0 end + case when avg_degree >= 2 then 30 else 0 end as score from y)
select *, case when score >= 80 then 'HEALTHY' when score >= 50 then 'FAIR' else 'POOR' end as status from z""", "avg_degree orphan_pct")
add("srt_easiest_roots", lambda v: G.easiest_roots(v.concepts, v.edges.filter("source % 3 <> 0")), "select concept_id, name, difficulty from {concepts} where concept_id not in (select source from {edges} where rel_type = 'REQUIRES' and source % 3 <> 0) order by difficulty, concept_id limit 10")
add("grf_cycle_check", lambda v: G.peel_cycles(v.edges))

# --- curation and provenance ----------------------------------------------------------------------
_old = lambda v: v.snapshots.filter("doc_id < 250").groupBy("concept_id").agg(F.concat(F.lit("old "), F.min("line").cast("string")).alias("name"), F.concat(F.lit("d"), F.max("price").cast("int").cast("string")).alias("description"), F.array_sort(F.collect_set("doc_id")).alias("docs"))
_new = lambda v: v.snapshots.filter("doc_id >= 400").groupBy("concept_id").agg(F.when(F.min("line") % 2 == 0, F.concat(F.lit("new "), F.min("line").cast("string"))).alias("name"), F.concat(F.lit("longer"), F.min("line").cast("string")).alias("description"), F.array_sort(F.collect_set("doc_id")).alias("docs"))
OLD = "select concept_id, concat('old ', min(line)) as name, concat('d', cast(trunc(max(price)) as int)) as description, list_sort(list(distinct doc_id)) as docs from {snapshots} where doc_id < 250 group by 1"
NEW = "select concept_id, case when min(line) % 2 = 0 then concat('new ', min(line)) end as name, concat('longer', min(line)) as description, list_sort(list(distinct doc_id)) as docs from {snapshots} where doc_id >= 400 group by 1"
_docs = lambda df: df.withColumn("docs", F.array_join(F.transform("docs", lambda x: x.cast("string")), ","))
add("sink_concept_upsert", lambda v: _docs(G.upsert_concepts(_old(v), _new(v))), f"""select coalesce(n.concept_id, o.concept_id) as concept_id, coalesce(n.name, o.name) as name, case when coalesce(length(n.description), -1) > coalesce(length(o.description), -1) then n.description else o.description end as description,
  array_to_string(list_sort(list_distinct(list_concat(coalesce(o.docs, []), coalesce(n.docs, [])))), ',') as docs from ({OLD}) o full join ({NEW}) n on n.concept_id = o.concept_id""")
add("sink_remove_provenance", lambda v: _docs(G.remove_provenance(_old(v), 7)).select("concept_id", "docs"), f"select concept_id, array_to_string(list_filter(docs, lambda x: x <> 7), ',') as docs from ({OLD}) o where len(list_filter(docs, lambda x: x <> 7)) > 0")
_fresh = lambda v: v.edges.filter("source % 2 = 0").withColumns({"weight": F.col("weight") / 2, "target": F.col("target") + F.when(F.col("source") % 10 == 0, 1).otherwise(0)})
FRESH = "select source, target + case when source % 10 = 0 then 1 else 0 end as target, rel_type, weight / 2 as weight from {edges} where source % 2 = 0"
add("sink_edge_upsert", lambda v: G.upsert_edges(v.edges, _fresh(v), v.concepts), f"""select source, target, rel_type, coalesce(n.weight, o.weight) as weight from {{edges}} o full join (
  select * from ({FRESH}) f where source in (select concept_id from {{concepts}}) and target in (select concept_id from {{concepts}})) n using (source, target, rel_type)""", "weight")
_map = lambda v: v.concepts.filter("concept_id % 10 = 9").select(F.col("concept_id").alias("from_id"), (F.col("concept_id") - 9).alias("to_id"))
add("set_edge_union_dedup", lambda v: G.union_edges(v.edges.filter("source % 2 = 1"), v.edges.filter("source % 2 = 0"), _map(v)), """with m as (select concept_id as f, concept_id - 9 as t from {concepts} where concept_id % 10 = 9),
e as (select source, target, rel_type, weight, 0 as p from {edges} where source % 2 = 1 union all select coalesce(a.t, source), coalesce(b.t, target), rel_type, weight, 1 from {edges} x left join m a on a.f = x.source left join m b on b.f = x.target where source % 2 = 0)
select source, target, rel_type, arg_min(weight, (p, weight)) as weight from e where source <> target group by 1, 2, 3""", "weight")
RANK = "row_number() over (partition by {} order by confidence desc, uploaded_at desc, doc_id, line, order_id, supp_id, price, quantity)"
add("win_canonical_concepts", lambda v: G.canonical(v.snapshots, ["concept_id"]).select("concept_id", "doc_id", "confidence", "price"), f"select concept_id, doc_id, confidence, price from (select *, {RANK.format('concept_id')} as r from {{snapshots}} where status = 'COMMITTED') x where r = 1", "confidence price")
add("win_canonical_edges", lambda v: G.canonical(v.snapshots, ["concept_id", "supp_id", "line"]).select("concept_id", "supp_id", "line", "doc_id", "confidence"), f"select concept_id, supp_id, line, doc_id, confidence from (select *, {RANK.format('concept_id, supp_id, line')} as r from {{snapshots}} where status = 'COMMITTED') x where r = 1", "confidence")
add("set_affected_concepts", lambda v: G.affected(v.snapshots.filter("doc_id = 3"), v.snapshots.filter("doc_id = 4")), "select distinct concept_id from {snapshots} where doc_id in (3, 4)")
# courses of concepts, and the course that each learner follows
_course = lambda v: v.concepts.select((F.col("concept_id") % 100).alias("course_id"), "concept_id")
_enrolled = lambda v: v.mastery.select("learner_id", (F.col("learner_id") % 100).alias("course_id")).distinct()
_own = lambda v: v.mastery.select("learner_id", F.col("concept_id").cast("long").alias("concept_id"))
add("set_sync_delta", lambda v: G.sync_delta(_course(v), _own(v), _enrolled(v)), """with p as (select learner_id, cast(concept_id as bigint) as concept_id, 1 as p from {mastery}), c as (select l.learner_id, c.concept_id, 1 as c from (select distinct learner_id from {mastery}) l join {concepts} c on c.concept_id % 100 = l.learner_id % 100)
select learner_id, concept_id, case when p is null then 'new' when c is null then 'deleted' else 'existing' end as change from p full join c using (learner_id, concept_id)""")
add("agg_concept_sources", lambda v: v.snapshots.groupBy("concept_id").agg(F.countDistinct("doc_id").alias("docs"), F.max("confidence").alias("best")), "select concept_id, count(distinct doc_id) as docs, max(confidence) as best from {snapshots} group by 1", "best")
add("agg_doc_contributions", lambda v: v.snapshots.groupBy("doc_id").agg(F.countDistinct("concept_id").alias("concepts"), F.count(F.lit(1)).alias("rows")), "select doc_id, count(distinct concept_id) as concepts, count(*) as \"rows\" from {snapshots} group by 1")

# --- validation -----------------------------------------------------------------------------------
_nodes = lambda v: v.pages.select(F.regexp_extract("url", "://([^/]*)", 1).alias("concept_id"), F.when(F.col("page_id") % 13 > 0, F.regexp_extract("url", r"\.(com|net|org)/", 1)).alias("name"), F.regexp_extract("url", "/(en|de|fr|es)/", 1).alias("description"), (F.col("page_id") % 8).cast("int").alias("difficulty"), (F.col("page_id") % 140).cast("int").alias("time_estimate"), F.when(F.col("page_id") % 9 == 0, "GUESS").otherwise("apply").alias("bloom"), F.col("page_id").alias("pos"))
NODES = "select regexp_extract(url, '://([^/]*)', 1) as concept_id, case when page_id % 13 > 0 then regexp_extract(url, '\\.(com|net|org)/', 1) end as name, regexp_extract(url, '/(en|de|fr|es)/', 1) as description, cast(page_id % 8 as int) as difficulty, cast(page_id % 140 as int) as time_estimate, case when page_id % 9 = 0 then 'GUESS' else 'apply' end as bloom, page_id as pos from pages"
_RULES = {
    "required": ("ERROR", "pos", "trim(coalesce(concept_id, '')) = '' or trim(coalesce(name, '')) = ''"), "id_format": ("WARNING", "concept_id", "trim(coalesce(concept_id, '')) <> '' and not regexp_full_match(concept_id, '[A-Za-z0-9_]+')"),
    "bloom_enum": ("WARNING", "concept_id", "upper(bloom) not in ('REMEMBER', 'UNDERSTAND', 'APPLY', 'ANALYZE', 'EVALUATE', 'CREATE')"), "difficulty": ("WARNING", "concept_id", "difficulty not between 1 and 5"),
    "time_range": ("WARNING", "concept_id", "time_estimate not between 15 and 120"), "description": ("WARNING", "concept_id", "coalesce(length(description), 0) < 10"),
}
for _name, (_severity, _item, _where) in _RULES.items():
    add(f"dq_{_name}", lambda v, n=_name: G.node_issues(_nodes(v))[n], f"select '{_name}' as rule, '{_severity}' as severity, cast({_item} as varchar) as item from ({NODES}) n where {_where}")
add("dq_unique", lambda v: G.node_issues(_nodes(v))["unique"], f"select 'unique' as rule, 'ERROR' as severity, concept_id as item from (select *, row_number() over (partition by concept_id order by pos) as r from ({NODES}) n) x where r > 1")
_ITEM = "concat(source, '>', target, '>', rel_type)"
_EDGE_RULES = {
    "ref_exists": ("ERROR", f"select distinct {_ITEM} as item from {{raw_edges}} where source not in (select concept_id from {{raw_nodes}}) or target not in (select concept_id from {{raw_nodes}})"),
    "self_loop": ("ERROR", f"select {_ITEM} as item from {{raw_edges}} where source = target"), "rel_type": ("WARNING", f"select {_ITEM} as item from {{raw_edges}} where rel_type not in ('REQUIRES', 'IS_PREREQUISITE_OF', 'NEXT', 'REMEDIATES', 'HAS_ALTERNATIVE_PATH', 'SIMILAR_TO', 'IS_SUB_CONCEPT_OF')"),
    "weight": ("WARNING", f"select {_ITEM} as item from {{raw_edges}} where weight not between 0 and 1"), "orphans": ("WARNING", "select cast(concept_id as varchar) as item from {raw_nodes} where concept_id not in (select source from {raw_edges} union all select target from {raw_edges})"),
}
for _name, (_severity, _sql) in _EDGE_RULES.items():
    add(f"dq_{_name}", lambda v, n=_name: G.edge_issues(v.raw_edges, v.raw_nodes)[n], f"select '{_name}' as rule, '{_severity}' as severity, item from ({_sql}) q")
add("dq_validate", lambda v: G.validate(v.raw_nodes, v.raw_edges), "with q as (" + " union all ".join([f"select '{n}' as rule, '{a}' as severity from {{raw_nodes}} n where {w}" for n, (a, _, w) in _RULES.items()] + [f"select '{n}', '{a}' from ({q}) e" for n, (a, q) in _EDGE_RULES.items()] + ["select 'unique', 'ERROR' from (select row_number() over (partition by concept_id) as r from {raw_nodes}) u where r > 1"]).replace("coalesce(concept_id, '')", "coalesce(cast(concept_id as varchar), '')").replace("regexp_full_match(concept_id,", "regexp_full_match(cast(concept_id as varchar),") + ") select rule, severity, count(*) as issues from q group by 1, 2")
add("dq_autofix_nodes", lambda v: G.autofix_nodes(_nodes(v)).select("pos", "concept_id", "bloom", "difficulty", "time_estimate"), f"select pos, regexp_replace(concept_id, '[^A-Za-z0-9_]', '_', 'g') as concept_id, case when bloom = 'apply' then 'APPLY' else 'UNDERSTAND' end as bloom, least(5, greatest(1, difficulty)) as difficulty, least(120, greatest(15, time_estimate)) as time_estimate from ({NODES}) n")
add("dq_autofix_edges", lambda v: G.autofix_edges(v.raw_edges, v.raw_nodes), "select * replace (case when rel_type = 'LIKES' then 'SIMILAR_TO' else rel_type end as rel_type) from {raw_edges} where source <> target and source in (select concept_id from {raw_nodes}) and target in (select concept_id from {raw_nodes})", "weight")
#: The declared unique keys, as SQL that both sides read: of concepts (two), learners, notes, staged concepts, documents, snapshots of concepts and of relations.
_UNIQUE = {
    "course_concept_id": ("concept_id", "concepts"), "course_concept_uuid": ("md5(concat(concept_id, ':', name))", "concepts"), "learner_id": ("c_custkey", "customer"), "note_id": ("note_id", "notes"),
    "staging_concept_id": ("concept_id", "raw_nodes"), "source_document_id": ("doc_id", "documents"), "concept_snapshot_id": ("concat(order_id, '-', line)", "snapshots"), "relationship_snapshot_id": ("concat(source, '-', target, '-', rel_type)", "raw_edges"),
}


def _duplicates(v):
    """How many keys of each declared unique key come more than once, and the rows that have them. A null key is unique."""
    out = None
    for name, (key, table) in _UNIQUE.items():
        n = getattr(v, table).select(F.expr(key).cast("string").alias("k")).filter("k is not null").groupBy("k").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
        found = n.agg(F.count(F.lit(1)).alias("keys"), F.coalesce(F.sum("n"), F.lit(0)).alias("rows")).select(F.lit(f"unique_{name}").alias("constraint_name"), "keys", "rows")
        out = found if out is None else out.unionByName(found)
    return out


add("dq_uniqueness_constraints", _duplicates, " union all ".join(f"select 'unique_{name}' as constraint_name, count(*) as keys, cast(coalesce(sum(n), 0) as bigint) as rows from (select {key} as k, count(*) as n from {table if table in ('customer', 'documents') else '{' + table + '}'} group by 1 having count(*) > 1 and {key} is not null) x" for name, (key, table) in _UNIQUE.items()))
add("dq_consent_before_use", lambda v: v.attempts.select("learner_id").distinct().join(v.runs.filter("status = 'success' and mode = 'real'").select("learner_id").distinct(), "learner_id", "left_anti"), "select distinct learner_id from {attempts} where learner_id not in (select learner_id from {runs} where status = 'success' and mode = 'real')")

# --- planning -------------------------------------------------------------------------------------
_pairs = lambda v: v.mastery.select("learner_id", F.col("concept_id").cast("long").alias("concept_id"), "level")
add("flt_eligible", lambda v: P.eligible(v.concepts, v.mastery, 60).drop("level"), "select m.learner_id, cast(m.concept_id as bigint) as concept_id, c.difficulty from {mastery} m join {concepts} c on c.concept_id = m.concept_id where c.time_estimate <= 60 and m.level < 0.9")
add("win_ucb_select", lambda v: P.ucb_select(A.bandit_stats(v.attempts), v.mastery), """with s as (select concept_id, count(*) as pulls, avg(score) as a from {attempts} group by 1), t as (select sum(pulls) + 1 as t from s), b as (select learner_id, m.concept_id, a + sqrt(2 * ln(t) / pulls) as bound from {mastery} m join s using (concept_id), t)
select learner_id, arg_max(concept_id, (bound, -concept_id)) as concept_id, max(bound) as bound from b group by 1""", "bound")
add("win_greedy_select", lambda v: P.greedy_select(P.eligible(v.concepts, v.mastery, 60)), """select learner_id, arg_max(concept_id, (gain, -concept_id)) as concept_id, max(gain) as gain from (
  select m.learner_id, cast(m.concept_id as bigint) as concept_id, (1 - level) * (1 - abs(difficulty / 5.0 - 0.5)) as gain from {mastery} m join {concepts} c on c.concept_id = m.concept_id where c.time_estimate <= 60 and m.level < 0.9) x group by 1""", "gain")
_FEATURES = lambda: [F.lit(1.0), F.col("difficulty") / 5.0, F.col("score")]
add("win_linucb_select", lambda v: P.linucb_select(A.linucb_arms(v.attempts, _FEATURES()), v.mastery.groupBy("learner_id").agg(F.array(F.lit(1.0), F.lit(0.6), F.avg("level")).alias("x")), 3))
add("win_topk_review", lambda v: P.review_queue(v.mastery), """select learner_id, concept_id, priority, cast(rank as int) as rank from (select *, row_number() over (partition by learner_id order by priority desc, concept_id) as rank from (
  select learner_id, concept_id, round((1 - exp(-(floor((1 - level) * 30) + 1) / greatest(1.0, level * 30))) * level, 9) as priority from {mastery} where level > 0.5) a) b where rank <= 10""", "priority")
add("join_review_notes", lambda v: P.review_notes(v.notes, v.mastery), "select n.learner_id, note_id, n.concept_id, level from {notes} n join {mastery} m using (learner_id, concept_id) where level < 0.6", "level")
MISSING = "select m.learner_id, cast(m.concept_id as bigint) as concept_id, count(*) as missing from {mastery} m join {edges} e on e.source = m.concept_id and e.rel_type = 'REQUIRES' where not exists (select 1 from {mastery} k where k.learner_id = m.learner_id and k.concept_id = e.target and k.level >= 0.7) group by 1, 2"
add("join_missing_prereqs", lambda v: P.missing_prerequisites(_pairs(v).drop("level"), v.edges, v.mastery), MISSING)
add("join_prereqs_met", lambda v: P.prerequisites_met(_pairs(v).drop("level"), v.edges, v.mastery), f"select learner_id, cast(concept_id as bigint) as concept_id from {{mastery}} m where not exists (select 1 from ({MISSING}) x where x.learner_id = m.learner_id and x.concept_id = m.concept_id)")
_mode = lambda c: P.chain_mode(F.when(F.col("level") >= 0.9, "MASTERED").when(F.col("level") >= 0.8, "PROCEED").when(F.col("level") >= 0.6, "ALTERNATE").when(F.col("level") >= 0.3, "REMEDIATE").otherwise("NONE"), F.col(c))
MODE = "case when level >= 0.9 then 'ACCELERATE' when level >= 0.8 then 'FORWARD' when level >= 0.6 then 'LATERAL' when level >= 0.3 then 'BACKWARD' when (learner_id * 7919) % 10 = 0 then 'REVIEW' else 'FORWARD' end"
add("prj_chain_mode", lambda v: v.mastery.select("learner_id", "concept_id", _mode("learner_id").alias("mode")), f"select learner_id, concept_id, {MODE} as mode from {{mastery}}")
add("grf_chain_candidates", lambda v: P.chain_candidates(_pairs(v).select("learner_id", "concept_id", _mode("learner_id").alias("mode")), v.edges, v.mastery), f"""with k(mode, rel_type) as (values ('FORWARD', 'NEXT'), ('FORWARD', 'IS_PREREQUISITE_OF'), ('BACKWARD', 'REQUIRES'), ('LATERAL', 'SIMILAR_TO'), ('LATERAL', 'HAS_ALTERNATIVE_PATH'), ('LATERAL', 'REMEDIATES'), ('ACCELERATE', 'NEXT'), ('ACCELERATE', 'IS_SUB_CONCEPT_OF'), ('REVIEW', 'REQUIRES'))
select distinct learner_id, target from (select learner_id, concept_id, {MODE} as mode from {{mastery}}) m join k using (mode) join {{edges}} e on e.source = m.concept_id and e.rel_type = k.rel_type where not exists (select 1 from {{mastery}} s where s.learner_id = m.learner_id and s.concept_id = target)""")
add("grf_accelerate", lambda v: P.accelerate(_pairs(v).filter("level >= 0.9").select("learner_id", "concept_id"), v.edges), """with a as (select learner_id, concept_id from {mastery} where level >= 0.9), n as (select source, target from {edges} where rel_type = 'NEXT'), one as (select learner_id, target from a join n on n.source = a.concept_id)
select learner_id, target, min(steps) as steps from (select *, 1 as steps from one union all select learner_id, n.target, 2 from one join n on n.source = one.target union all select learner_id, e.target, 1 from a join {edges} e on e.source = a.concept_id and e.rel_type = 'IS_SUB_CONCEPT_OF') x group by 1, 2""")
_steps = lambda v: v.attempts.join(v.mastery, ["learner_id", "concept_id"]).select("learner_id", F.col("attempt_id").alias("pos"), R.hours(F.col("difficulty"), F.lit(1.0)).alias("hours"), "level", "difficulty")
STEPS = "select learner_id, attempt_id as pos, 0.5::double * list_extract([0.5, 0.8, 1.0, 1.5, 2.0], difficulty)::double as hours, level, difficulty from {attempts} join {mastery} using (learner_id, concept_id)"
add("win_path_schedule", lambda v: P.schedule(_steps(v), 2.0, 24.0), f"select learner_id, pos, hours, cast(floor(before / 2.0) as bigint) + 1 as day from (select *, coalesce(round(sum(hours) over (partition by learner_id order by pos rows between unbounded preceding and 1 preceding), 6), 0) as before from ({STEPS}) s) x where before < 0.8 * 24.0", "hours")
add("mth_success_probability", lambda v: P.success_probability(_steps(v), 60.0), f"select learner_id, least(1.0, greatest(0.0, 0.4 * avg(level) + 0.4 * least(1.0, 60.0 / sum(hours)) - 0.2 * greatest(0.0, (avg(difficulty) - 3.0) * 0.1))) as probability from ({STEPS}) s group by 1", "probability")
_best_known = lambda v: v.mastery.groupBy("learner_id").agg(F.max_by(F.col("concept_id").cast("long"), F.struct("level", -F.col("concept_id"))).alias("concept_id"))


def _beam_sql(depth: int = 3, width: int = 3) -> str:
    out = """with st as (select learner_id, cast(arg_max(concept_id, (level, -concept_id)) as bigint) as concept_id from {mastery} group by 1),
step as (select distinct e.source as last, e.target as nxt, c.time_estimate / 60.0::double as hours, c.difficulty from {edges} e join {concepts} c on c.concept_id = e.target where e.rel_type in ('NEXT', 'SIMILAR_TO')),
need as (select distinct e.source as nxt, e.target as needed from {edges} e join {concepts} c on c.concept_id = e.target where e.rel_type = 'REQUIRES'),
needs as (select nxt, count(*) as needs from need group by 1),
met as (select m.learner_id, n.nxt, count(*) as met from {mastery} m join need n on n.needed = m.concept_id where m.level >= 0.7 group by 1, 2),
p0 as (select s.learner_id, s.concept_id as last, [s.concept_id] as path, coalesce(m.level, 0)::double as m, c.time_estimate / 60.0::double as h, c.difficulty::double as d, 0.0::double as score from st s join {concepts} c on c.concept_id = s.concept_id left join {mastery} m on m.learner_id = s.learner_id and m.concept_id = s.concept_id)"""
    for k in range(1, depth):
        out += f""",
l{k} as (select p.learner_id, coalesce(t.nxt, p.last) as last, case when t.nxt is not null then list_append(p.path, t.nxt) else p.path end as path, p.m + case when t.nxt is not null then coalesce(m.level, 0) else 0 end as m, p.h + coalesce(t.hours, 0) as h, p.d + coalesce(t.difficulty, 0) as d,
  t.nxt is not null and coalesce(met.met, 0) >= coalesce(needs.needs, 0) as open from p{k - 1} p left join step t on t.last = p.last left join {{mastery}} m on m.learner_id = p.learner_id and m.concept_id = t.nxt left join needs on needs.nxt = t.nxt left join met on met.learner_id = p.learner_id and met.nxt = t.nxt
  where t.nxt is null or not list_contains(p.path, t.nxt)),
s{k} as (select *, case when open then least(1.0, greatest(0.0, 0.4 * m / len(path) + 0.4 * case when h > 0 then least(1.0, 20.0 / h) else 1.0 end - 0.2 * greatest(0.0, (d / len(path) - 3.0) * 0.1))) else 0.0 end as score from l{k}),
p{k} as (select * exclude (r) from (select *, row_number() over (partition by learner_id order by round(score, 9) desc, path) as r from s{k}) x where r <= {width})"""
    return out + f" select learner_id, array_to_string(list_transform(path, lambda x: x::varchar), '>') as path, score from p{depth - 1}"


add("grf_beam_search", lambda v: P.beam_search(_best_known(v), v.edges, v.mastery, v.concepts), _beam_sql(), "score")
_sel = lambda v: v.attempts.filter("attempt_id % 2 = 0").select("concept_id", "ts", F.col("score").alias("context"))
_fb = lambda v: v.attempts.filter("attempt_id % 2 = 1").select("concept_id", "ts", F.col("attempt_id").alias("feedback_id"))
add("join_context_asof", lambda v: P.context_asof(_sel(v), _fb(v)), """select f.attempt_id as feedback_id, case when floor(epoch(f.ts)) - floor(epoch(s.ts)) <= 86400 then s.score end as context from {attempts} f left join lateral (
  select ts, score from {attempts} s where s.attempt_id % 2 = 0 and s.concept_id = f.concept_id and s.ts <= f.ts order by ts desc, score desc limit 1) s on true where f.attempt_id % 2 = 1""", "context")

# --- documents and texts --------------------------------------------------------------------------
add("doc_register", lambda v: D.register(v.documents), "select doc_id, sha256(coalesce(text, '')) as checksum, case when doc_id = min(doc_id) over (partition by coalesce(text, '')) then 'PENDING' else 'SKIPPED' end as status from documents")
add("str_checksum", lambda v: v.documents.select("doc_id", F.sha2("text", 256).alias("checksum")), "select doc_id, sha256(text) as checksum from documents")
add("str_token_estimate", lambda v: D.token_estimate(v.documents), "select doc_id, length(text) // 4 as tokens, case when length(text) // 4 > 2000 then 'large' else 'small' end as route from documents")
CHUNKS = "select doc_id, cast(i as int) as chunk, substring(text, cast(i * 2000 + 1 as int), 2000) as text from documents, unnest(range(0, greatest(1, cast(ceil(length(text) / 2000.0) as bigint)))) as t(i)"
add("doc_fixed_chunks", lambda v: D.fixed_chunks(v.documents).withColumn("text", F.md5("text")), f"select doc_id, chunk, md5(text) as text from ({CHUNKS}) c")
add("agg_chunk_stats", lambda v: A.chunk_stats(D.fixed_chunks(v.documents)), f"select doc_id, count(*) as chunks, cast(sum(len(list_filter(regexp_split_to_array(text, '\\s+'), lambda w: w <> ''))) as bigint) as words, cast(sum(length(text)) as bigint) as chars, avg(length(text)) as avg_chars, min(length(text)) as min_chars, max(length(text)) as max_chars from ({CHUNKS}) c group by 1", "avg_chars")
add("doc_paragraphs", lambda v: D.paragraphs(v.documents))
add("doc_paragraph_summary", lambda v: D.first_sentences(v.documents).withColumn("summary", F.md5("summary")), "select doc_id, md5(substring(array_to_string(string_split(regexp_replace(text, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1))[1:3], ' '), 1, 400)) as summary from documents")
_NAMES = "select distinct lower(name) as name from (select name from {concepts} union all select brand from {concepts} union all select kind from {concepts} union all select description from {concepts} union all select concat(brand, ' ', name) from {concepts}) n"
add("join_name_contains", lambda v: D.containing_names(v.spark.sql(_NAMES, concepts=v.concepts)), f"with n as ({_NAMES}) select a.name as outer, b.name as inner from n a join n b on a.name <> b.name and contains(a.name, b.name)")
_names = lambda v: v.concepts.select("name").distinct()
add("join_fuzzy_name", lambda v: D.fuzzy_names(_names(v), _names(v)), "with n as (select distinct name from {concepts}) select a.name as a, b.name as b, 1 - levenshtein(a.name, b.name) / greatest(length(a.name), length(b.name))::double as similarity from n a join n b on a.name < b.name where levenshtein(a.name, b.name) <= 0.2 * greatest(length(a.name), length(b.name)) + 1e-9", "similarity")
#: Every hundredth embedding, without its first eight numbers, asks for its like and for a topic among the notes.
_ask = lambda v: v.embeddings.filter("vec_id % 100 = 0").select((-1 - F.col("vec_id")).alias("query"), F.concat(F.array_repeat(F.lit(0.0), 8).cast("array<float>"), F.slice("embedding", 9, 100_000)).alias("vec"), F.concat(F.lit("topic "), (F.floor(F.col("vec_id") / 100) % 7).cast("string")).alias("asked"))


def _fused(v):
    items = v.embeddings.select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"))
    items = items.join(v.notes.select(F.col("note_id").alias("id"), "content"), "id")
    near = topk_similar(_ask(v).select(F.col("query").alias("id"), "vec"), items, 10).join(items.select(F.col("id").alias("item"), "content"), "item")
    held = D.newest_holding(v.notes.select("content", F.col("created_at").alias("date")), _ask(v))
    return D.hybrid_search(near.select("query", "content", F.col("cos").alias("score")), held)


add("set_hybrid_fusion", _fused, """with e as (select vec_id as id, embedding::double[] as vec, content from embeddings join {notes} on note_id = vec_id),
q as (select -1 - vec_id as query, list_concat([0.0::double, 0, 0, 0, 0, 0, 0, 0], embedding[9:]::double[]) as vec, concat('topic ', vec_id // 100 % 7) as asked from embeddings where vec_id % 100 = 0),
v as (select query, content, cos as score from (select *, row_number() over (partition by query order by cos desc, id) as r from (select query, e.id, content, round(list_cosine_similarity(q.vec, e.vec), 9) as cos from q, e) a) b where r <= 10),
h as (select query, content, 'vector' as source, score, 0 as p, row_number() over (partition by query order by score desc, content) as r from v where score > 0.7
  union all select * from (select query, content, 'keyword', 1.0, 1, row_number() over (partition by query order by created_at desc, content) as r from q join {notes} on contains(content, asked)) k where r <= 10),
b as (select * from (select *, row_number() over (partition by query, content order by p, r) as o from h) o where o = 1)
select query, content, source, score, cast(rank as int) as rank, (rank - 1) // 5 as page from (select *, row_number() over (partition by query order by p, r) as rank from b) x""", "score")
add("str_leak_guard", lambda v: D.leak_guard(v.documents, ("Therefore", "The answer is", "So", "Thus", "Hence")), "select doc_id, len(l) as lines, md5(array_to_string(l, chr(10))) as digest from (select doc_id, list_filter(string_split(text, chr(10)), lambda x: not regexp_matches(x, 'Therefore|The answer is|So|Thus|Hence')) as l from documents) x")
add("str_pedagogy_check", lambda v: D.pedagogy_check(v.conversations), """with w as (select conv_id, turn, lower(text) as t, len(list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '')) as n from conversations),
x as (select conv_id, turn, list_filter([case when not regexp_matches(t, '\\?|try|think') then 'active_learning' end, case when n > 120 then 'cognitive_load' end, case when not regexp_matches(t, 'first|next|step|then') then 'scaffolding' end, case when regexp_matches(t, 'the answer is|solution is') then 'no_answer' end,
  case when regexp_matches(t, 'wrong|bad|stupid|idiot') then 'growth' end, case when n < 5 then 'feedback' end, case when not regexp_matches(t, 'you') then 'personal' end], lambda v: v is not null) as f from w)
select conv_id, turn, array_to_string(f, ',') as violations, 1 - len(f) / 7.0 as score from x""", "score")
add("str_sanitize_id", lambda v: v.part.select("p_partkey", R.sanitize(F.concat_ws("-", "p_brand", "p_name")).alias("code")), "select p_partkey, regexp_replace(regexp_replace(regexp_replace(translate(lower(concat(p_brand, '-', p_name)), '- ', '__'), '[^a-z0-9_]', '', 'g'), '_+', '_', 'g'), '^_|_$', '', 'g') as code from part")
add("str_concept_code", lambda v: v.part.select("p_partkey", R.concept_code(F.col("p_type"), F.col("p_name")).alias("code")), "select p_partkey, concat(lower(p_type), '.', replace(p_name, ' ', '_')) as code from part")
add("str_valid_code", lambda v: v.pages.select("page_id", R.valid_code(F.regexp_extract("url", "://([^/]*)", 1)).alias("valid")), "select page_id, regexp_full_match(regexp_extract(url, '://([^/]*)', 1), '[a-z][a-z0-9_]*(\\.[a-z][a-z0-9_]*)+') as valid from pages")
add("str_word_jaccard", lambda v: v.concepts.select("concept_id", R.word_jaccard(F.col("name"), F.col("description")).alias("j")), "select concept_id, len(list_intersect(string_split(lower(name), ' '), string_split(lower(description), ' '))) / len(list_distinct(list_concat(string_split(lower(name), ' '), string_split(lower(description), ' '))))::double as j from {concepts}", "j")
add("str_edit_similarity", lambda v: v.concepts.select("concept_id", R.edit_similarity(F.col("name"), F.col("description")).alias("s")), "select concept_id, 1 - levenshtein(trim(lower(name)), trim(lower(description))) / greatest(length(trim(name)), length(trim(description)))::double as s from {concepts}", "s")
_judge = lambda v: v.attempts.select(F.col("attempt_id").alias("id"), F.when(F.col("attempt_id") % 3 == 0, F.concat(F.lit("10 "), (F.col("attempt_id") % 11).cast("string"))).otherwise(F.concat(F.lit('Verdict: {"accuracy": '), (F.col("attempt_id") % 10).cast("string"), F.lit(', "clarity": 5, "score": '), F.col("difficulty").cast("string"), F.lit(', "label": "l'), F.col("concept_id").cast("string"), F.lit('"} end'))).alias("text"))
add("jsn_judge_score", lambda v: D.judge_score(_judge(v)), "select attempt_id as id, case when attempt_id % 3 = 0 then least(1.0, (attempt_id % 11) / 10.0) else (0.6 * (attempt_id % 10) + 0.2 * 5) / 10 end as score from {attempts}", "score")
add("jsn_extract_object", lambda v: D.json_object(_judge(v)), "select attempt_id as id, case when attempt_id % 3 <> 0 then cast(difficulty as double) end as score, case when attempt_id % 3 <> 0 then concat('l', concept_id) end as label from {attempts}", "score")
