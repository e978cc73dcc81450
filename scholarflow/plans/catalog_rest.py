"""Remaining queries: rewrites, domains, sections, catalogues, experiments as tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import more_rules as S
from ..operators import analytics as A
from ..operators import graph as G
from ..operators import text as D
from ..sources import tables
from ..store import new_folder
from .registry import add

_said = lambda: F.concat_ws(" ", F.when(F.col("turn") % 2 == 0, "You can't skip this.").otherwise("It's too hard now."), "text")
SAID = "concat(case when turn % 2 = 0 then 'You can''t skip this.' else 'It''s too hard now.' end, ' ', text)"
add("str_pedagogy_rewrite", lambda v: v.conversations.select("conv_id", "turn", F.md5(S.growth_phrases(_said())).alias("growth"), F.md5(S.shorten(F.col("text"), 40)).alias("short"), F.md5(S.numbered(F.col("text"))).alias("steps")), f"""with w as (select *, string_split(text, '. ') as p from conversations)
select conv_id, turn, md5(regexp_replace(regexp_replace({SAID}, '(?i)you can''t', 'you haven''t learned how to yet', 'g'), '(?i)it''s too hard', 'it''s challenging, which helps you learn', 'g')) as growth,
  md5(case when len(string_split(text, ' ')) > 40 then concat(array_to_string(p[1:greatest(2, len(p) // 2)], '. '), '.') else text end) as short,
  md5(case when len(p) > 1 then array_to_string(list_transform(p[1:5], lambda x, i: concat(i, '. ', x)), chr(10)) else text end) as steps from w""")
_trace = lambda v: v.attempts.select(F.col("learner_id").alias("id"), F.col("attempt_id").alias("pos"), F.when(F.col("attempt_id") % 50 == 0, F.concat(F.lit("CoT: x Student Hint: try "), F.col("concept_id").cast("string"))).otherwise(F.concat(F.lit("CoT "), F.col("attempt_id").cast("string"))).alias("text"))
add("str_consensus_trace", lambda v: D.consensus_trace(_trace(v)), """with t as (select learner_id as id, attempt_id as pos, concept_id, attempt_id % 50 = 0 as ok, case when attempt_id % 50 = 0 then concat('CoT: x Student Hint: try ', concept_id) else concat('CoT ', attempt_id) end as text from {attempts})
select id, coalesce(concat('try ', arg_min(concept_id, pos) filter (ok)), arg_max(text, (length(text), -pos))) as hint from t group by 1""".replace("coalesce(concat('try ', arg_min(concept_id, pos) filter (ok)),", "coalesce('try ' || cast(arg_min(concept_id, pos) filter (ok) as varchar),"))
_domains = "select * from (values ('sql', 'Structured Query Language', array('gear', 'ring'), 1), ('stats', 'Statistics', array('widget', 'hot'), 2), ('ml', 'Machine Learning', array('gizmo'), 3)) as t(key, name, aliases, ordinal)"
add("str_domain_map", lambda v: D.map_domains(v.concepts.select(F.col("concept_id").alias("id"), F.col("name").alias("text")), v.spark.sql(_domains)), """with d(key, aliases, ordinal) as (values ('sql', ['gear', 'ring'], 1), ('stats', ['widget', 'hot'], 2), ('ml', ['gizmo'], 3)),
s as (select concept_id as id, key, ordinal, coalesce(list_max(list_transform(aliases, lambda a: case when a = name then 0.95 when contains(name, a) then least(0.85, 0.6 + length(a) / 50.0) else 0 end)), 0) as score from {concepts}, d),
b as (select id, arg_max(key, (score, -ordinal)) as key, max(score) as score from s group by 1) select id, case when score > 0 then key else 'general' end as domain, score, score < 0.7 as needs_confirmation from b""", "score")
_alias = lambda v: v.concepts.select(F.col("name").alias("alias"), F.col("brand").alias("key")).distinct()
_action = lambda v: v.concepts.select(F.col("name").alias("alias")).distinct().select("alias", F.when(F.length("alias") % 3 == 0, "approve").when(F.length("alias") % 3 == 1, "reject").otherwise("deprecate").alias("action"), F.lit("merged").alias("key")).filter("alias not like 'r%'")
add("str_context_lifecycle", lambda v: D.apply_context_actions(_alias(v), _action(v)), "select name as alias, case when name not like 'r%' then 'merged' else brand end as key from (select distinct name, brand from {concepts}) a where name like 'r%' or length(name) % 3 = 0")
_tree = lambda v: v.lineitem.select((F.col("l_orderkey") % 200).alias("doc_id"), F.col("l_linenumber").cast("long").alias("n")).distinct().select("doc_id", (F.col("n") * F.col("n") * 30_000_000_000).alias("node"), F.when(F.col("n") > 1, F.floor(F.col("n") / 2) * F.floor(F.col("n") / 2) * 30_000_000_000).alias("parent"), F.concat(F.lit("s"), F.col("n").cast("string")).alias("title"))
add("doc_tree_sections", lambda v: D.tree_sections(_tree(v)), """with recursive n as (select distinct l_orderkey % 200 as doc_id, cast(l_linenumber as bigint) as n from lineitem), t as (select doc_id, n, [n] as sort, concat('s', n) as path from n where n = 1
  union all select n.doc_id, n.n, list_append(t.sort, n.n), concat(t.path, ' > s', n.n) from t join n on n.doc_id = t.doc_id and n.n > 1 and n.n // 2 = t.n)
select doc_id, n * n * 30000000000 as node, path, cast(row_number() over (partition by doc_id order by sort) as int) as pos from t""")
_starts = lambda v: v.documents.select("doc_id", F.explode(F.array(F.struct(F.lit(0).alias("pos"), F.substring("text", 1, 30).alias("s")), F.struct(F.lit(1).alias("pos"), F.lower(F.substring("text", 40, 60)).alias("s")), F.struct(F.lit(2).alias("pos"), F.lit("no such text in it at all").alias("s")))).alias("x")).select("doc_id", "x.pos", F.col("x.s").alias("start_text"))
add("doc_locate_sections", lambda v: D.locate_sections(v.documents, _starts(v).filter("start_text <> ''")), """with s as (select doc_id, 0 as pos, substring(text, 1, 30) as s, text from documents union all select doc_id, 1, lower(substring(text, 40, 60)), text from documents union all select doc_id, 2, 'no such text in it at all', text from documents),
f as (select doc_id, pos, case when instr(text, s) > 0 then instr(text, s) else instr(lower(text), array_to_string(string_split(lower(s), ' ')[1:5], ' ')) end as start, length(text) as n from s where s <> ''), k as (select * from f where start > 0)
select doc_id, pos, cast(start as int) as start, cast(coalesce(lead(start) over (partition by doc_id order by pos) - 1, n) as int) as "end" from k""")
_catalogue = lambda v: v.part.select((F.col("p_partkey") % 20).cast("int").alias("concept_id"), F.when(F.col("p_size") % 2 == 0, "CONCEPTUAL").otherwise("CARELESS").alias("category"), F.col("p_type").alias("kind"), F.col("p_name").alias("description")).distinct()
_answers = lambda v: v.part.select(F.col("p_partkey").alias("id"), (F.col("p_partkey") % 25).cast("int").alias("concept_id"), F.lit("CONCEPTUAL").alias("category"), F.concat(F.lit("a "), F.col("p_name")).alias("text"))
add("mth_misconceptions", lambda v: D.misconceptions(_answers(v), _catalogue(v)), """with a as (select p_partkey as id, cast(p_partkey % 25 as int) as concept_id, concat('a ', p_name) as text from part), c as (select distinct cast(p_partkey % 20 as int) as concept_id, p_size % 2 = 0 as conceptual, p_type as kind, p_name as description from part)
select id, kind, 'HIGH' as severity, 1 - levenshtein(text, description) / greatest(length(text), length(description))::double as confidence from a join c using (concept_id) where conceptual and 1 - levenshtein(text, description) / greatest(length(text), length(description))::double >= 0.65
union all select id, 'unknown_conceptual', 'HIGH', 0.6::double from a where concept_id not in (select concept_id from c)""", "confidence")
_grades = lambda v: v.attempts.select("concept_id", F.col("score").alias("grade"), (F.col("difficulty") * 1.0 + F.col("score")).alias("reference"), (F.col("attempt_id") % 37).alias("length"))
add("agg_grader_quality", lambda v: A.grader_quality(_grades(v), ["concept_id"]), """with g as (select concept_id, score as grade, difficulty * 1.0::double + score as reference, attempt_id % 37 as len from {attempts}), n as (select *, row_number() over (partition by concept_id order by grade) as a, row_number() over (partition by concept_id order by reference) as b, row_number() over (partition by concept_id order by len) as c from g),
r as (select concept_id, grade, avg(a) over (partition by concept_id, grade) as rg, avg(b) over (partition by concept_id, reference) as rr, avg(c) over (partition by concept_id, len) as rl from n) select concept_id, corr(rg, rr) as rho, corr(rg, rl) as length_bias, stddev_samp(grade) as spread from r group by 1""", "rho length_bias spread")
add("grf_course_concepts", lambda v: G.prerequisite_closure(v.edges.filter("rel_type = 'IS_SUB_CONCEPT_OF'").withColumn("rel_type", F.lit("REQUIRES")), 5), """with recursive h as (select distinct source, target from {edges} where rel_type = 'IS_SUB_CONCEPT_OF'), t as (select source as concept_id, target as prerequisite, 1 as depth from h union all select t.concept_id, h.target, depth + 1 from t join h on h.source = t.prerequisite where depth < 5)
select concept_id, prerequisite, min(depth) as depth from t group by 1, 2""")
_quality = lambda v: v.snapshots.select(F.concat_ws("-", "order_id", "line", "concept_id").alias("item"), "confidence", (F.col("quantity") % 4).cast("int").alias("dep"))
add("dq_confidence", lambda v: _quality(v).filter(~F.coalesce(F.col("confidence").between(0.92, 1), F.lit(False))).groupBy(F.lit("confidence").alias("rule")).agg(F.count(F.lit(1)).alias("issues")), "select 'confidence' as rule, count(*) as issues from {snapshots} where confidence not between 0.92 and 1")
add("dq_dependency", lambda v: _quality(v).withColumn("kind", F.element_at(F.array(*map(F.lit, ("STRONG", "MODERATE", "WEAK", "OTHER"))), F.col("dep") + 1)).filter(~F.col("kind").isin("STRONG", "MODERATE", "WEAK")).groupBy(F.lit("dependency").alias("rule")).agg(F.count(F.lit(1)).alias("issues")), "select 'dependency' as rule, count(*) as issues from {snapshots} where cast(quantity as int) % 4 = 3")
_mastery_map = lambda v: v.mastery.groupBy(F.col("learner_id").cast("string").alias("learner_id")).agg(F.to_json(F.struct(F.map_from_entries(F.collect_list(F.struct(F.concat(F.lit("c"), F.col("concept_id").cast("string")), F.round("level", 6)))).alias("concept_mastery_map"), F.count(F.lit(1)).alias("version"))).alias("profile"))
add("jsn_profile_flatten", lambda v: _mastery_map(v).select("learner_id", F.from_json("profile", "concept_mastery_map map<string,double>, version int").alias("p")).select("learner_id", "p.version", F.explode("p.concept_mastery_map").alias("concept", "level")).groupBy("concept").agg(F.count(F.lit(1)).alias("learners"), F.max("version").alias("most"), F.avg("level").alias("level")), """select concat('c', concept_id) as concept, count(*) as learners, cast(max(n) as int) as most, avg(level) as level from (select learner_id, concept_id, level, count(*) over (partition by learner_id) as n from {mastery}) m group by 1""", "level")


def _experiment(v):
    """Groups, assignments and the consent log, each read with its own schema."""
    where = new_folder(v.spark, "experiment")
    v.outcomes.select(F.col("learner_id").cast("string").alias("user_id"), F.col("cohort").alias("group_id")).write.json(f"{where}/user_experiments")
    v.runs.select(F.col("learner_id").cast("string").alias("user_id"), (F.col("status") == "success").alias("granted"), F.col("started_at").cast("timestamp").alias("at")).write.json(f"{where}/user_consents")
    assigned = v.spark.read.schema("user_id string, group_id string").json(f"{where}/user_experiments")
    consents = v.spark.read.schema("user_id string, granted boolean, at timestamp").json(f"{where}/user_consents")
    return assigned.join(consents.groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("granted"), 1)).alias("yes")), "user_id", "left").groupBy("group_id").agg(F.count(F.lit(1)).alias("learners"), F.sum(F.coalesce("n", F.lit(0))).alias("log_rows"), F.sum(F.coalesce("yes", F.lit(0))).alias("granted"))


add("src_experiment", _experiment, "select cohort as group_id, count(*) as learners, cast(sum(coalesce(n, 0)) as bigint) as log_rows, cast(sum(coalesce(yes, 0)) as bigint) as granted from {outcomes} left join (select learner_id, count(*) as n, count(*) filter (status = 'success') as yes from {runs} group by 1) c using (learner_id) group by 1")


def _tests(v):
    """Course tests as JSON documents with an array of questions."""
    where = new_folder(v.spark, "tests")
    q = F.collect_list(F.struct(F.col("item_id").cast("string").alias("id"), F.lit("mcq").alias("type"), F.col("text").alias("question"), F.lit("a").alias("correct_answer"), (F.col("item_id") % 3 + 1).cast("int").alias("points")))
    v.benchmark.groupBy((F.col("item_id") % 4).cast("string").alias("test_id")).agg(q.alias("questions")).write.option("lineSep", "\n").json(where)
    rows = v.spark.read.schema(tables.TESTS).json(where).select("test_id", F.explode("questions").alias("q"))
    return rows.groupBy("test_id").agg(F.count(F.lit(1)).alias("questions"), F.sum("q.points").alias("points"), F.sum(F.length("q.question")).alias("letters"))


add("src_course_tests", _tests, "select cast(item_id % 4 as varchar) as test_id, count(*) as questions, cast(sum(item_id % 3 + 1) as bigint) as points, cast(sum(length(text)) as bigint) as letters from benchmark group by 1")


def _taxonomy(v):
    where = new_folder(v.spark, "taxonomy")
    v.documents.groupBy("source", "lang").agg(F.count(F.lit(1)).cast("string").alias("value")).write.partitionBy("source", "lang").text(where)
    rows = v.spark.read.text(where, recursiveFileLookup=True).select(F.split(F.col("_metadata.file_path"), "/").alias("p"), F.col("value").cast("long").alias("n"))
    return rows.select(F.replace(F.element_at("p", -3), F.lit("source="), F.lit("")).alias("course"), F.replace(F.element_at("p", -2), F.lit("lang="), F.lit("")).alias("concept"), "n")


add("src_path_taxonomy", _taxonomy, "select source as course, lang as concept, count(*) as n from documents group by 1, 2")


def _analysis(v):
    """An analysis run as one row: its recommendations as an array, and how many bottlenecks there were."""
    where = new_folder(v.spark, "analysis")
    found = A.bottlenecks(A.concept_stats(v.mastery))
    found.agg(F.count(F.when(F.col("kind") == "difficult", 1)).alias("bottlenecks"), F.array_sort(F.collect_list("insight")).alias("insights")).write.mode("append").parquet(where)
    return v.spark.read.parquet(where).select("bottlenecks", F.size("insights").alias("insights"))


add("sink_analysis", _analysis, "select count(*) filter (a < 0.4) as bottlenecks, cast(count(*) as int) as insights from (select concept_id, avg(level) as a from {mastery} group by 1) s where a < 0.4 or a > 0.8")


def _staging(v):
    """Two extractions, staged and committed one after the other: the second changes some rows of the first and adds others."""
    where = new_folder(v.spark, "extractions")
    for extraction, rows, suffix in (("1", v.concepts.filter("difficulty <= 3"), ""), ("2", v.concepts.filter("difficulty >= 3"), " (2)")):
        tables.stage(rows.select("concept_id", F.concat("name", F.lit(suffix)).alias("name")), where, extraction)
        tables.commit(v.spark, where, extraction, "concept_id")
    return tables.published(v.spark, where)


add("sink_staging", _staging, "select concept_id, case when difficulty >= 3 then concat(name, ' (2)') else name end as name from {concepts}")
