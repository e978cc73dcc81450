"""Domain tables derived from the given ones, in SQL that Spark and DuckDB read alike.

Each view names its inputs in braces; Spark binds them to DataFrames, the oracle inlines them as
common table expressions, so both sides start from the same definitions.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")

VIEWS = {
    "attempts": """
select user_id as learner_id, cast(k % 20 as int) as concept_id, ts, event_id as attempt_id,
  least(value / (10.0E0 + 10.0E0 * (k % 20)), 1.0E0) as score, cast(1 + k % 5 as int) as difficulty,
  case event_type when 'view' then 'REMEMBER' when 'click' then 'UNDERSTAND' when 'signup' then 'APPLY' when 'purchase' then 'ANALYZE' else 'EVALUATE' end as bloom,
  case event_type when 'view' then 'factual' when 'click' then 'conceptual' when 'signup' then 'application' when 'purchase' then 'synthesis' else 'other' end as qtype,
  case when event_type = 'error' then 'CONCEPTUAL' when k % 3 = 0 then 'CARELESS' else 'INCOMPLETE' end as err,
  case when k % 2 = 0 then 'VIDEO' else 'ARTICLE' end as content_type
from (select *, cast(regexp_extract(props, '([0-9]+)', 1) as int) as k from {events}) e
where user_id is not null and value is not null""",
    "mastery": """
select learner_id, concept_id, score as level from (
  select learner_id, concept_id, score, row_number() over (partition by learner_id, concept_id order by ts desc, attempt_id desc) as rn from {attempts}) a
where rn = 1""",
    "concepts": """
select p_partkey as concept_id, p_name as name, concat(p_brand, ' ', p_type) as description, cast(1 + p_size % 5 as int) as difficulty,
  cast(15 + 2 * p_size as int) as time_estimate, p_brand as brand, p_type as kind,
  case p_size % 6 when 0 then 'REMEMBER' when 1 then 'UNDERSTAND' when 2 then 'APPLY' when 3 then 'ANALYZE' when 4 then 'EVALUATE' else 'CREATE' end as bloom
from {part}""",
    "edges": """
select p_partkey as source, cast(floor(p_partkey / 2) as bigint) as target, 'REQUIRES' as rel_type, 1.0E0 as weight from {part} where p_partkey > 0
union all
select p_partkey, p_partkey + 1, 'NEXT', 0.9E0 from {part}
union all
select source, target, 'SIMILAR_TO', 0.5E0 from (
  select p_partkey as source, lead(p_partkey) over (partition by p_brand, p_type order by p_partkey) as target from {part}) s where target is not null
union all
select p_partkey, p_partkey + 7, 'IS_SUB_CONCEPT_OF', 0.7E0 from {part} where p_partkey % 11 = 3
union all
select p_partkey, p_partkey - 5, 'REMEDIATES', 0.4E0 from {part} where p_partkey % 13 = 6""",
    # edges and nodes as an extraction may leave them: loops, unknown relations, weights beyond 1, nodes that nothing links
    "raw_edges": """
select * from {edges}
union all
select p_partkey, p_partkey, 'NEXT', 0.9E0 from {part} where p_partkey % 97 = 5
union all
select p_partkey, p_partkey + 3, case when p_partkey % 2 = 0 then 'LIKES' else 'NEXT' end, 1.0E0 + p_partkey % 3 / 10.0E0 from {part} where p_partkey % 89 in (4, 5)""",
    "raw_nodes": """
select concept_id, name, description, difficulty, time_estimate, bloom, concept_id as pos from {concepts}
union all
select -1 - s_suppkey, case when s_suppkey % 5 = 0 then ' ' else s_name end, null, cast(s_nationkey % 7 as int), 10, 'APPLY', -1 - s_suppkey from {supplier}""",
    "snapshots": """
select l_orderkey % 500 as doc_id, l_partkey as concept_id, l_linenumber as line, 1.0E0 - l_discount as confidence, l_shipdate as uploaded_at,
  l_extendedprice as price, l_quantity as quantity, case when l_orderkey % 500 % 17 = 0 then 'DELETED' else 'COMMITTED' end as status, l_orderkey as order_id, l_suppkey as supp_id
from {lineitem}""",
    "outcomes": """
select learner_id, cohort, condition, pre, post, retention from (
  select user_id as learner_id, case when user_id % 2 = 0 then 'treatment' else 'control' end as cohort, cast(user_id % 5 as int) as condition,
    100.0E0 * avg(case when ts < timestamp '2024-01-11 00:00:00' then least(value / 100.0E0, 1.0E0) end) as pre,
    100.0E0 * avg(case when ts >= timestamp '2024-01-11 00:00:00' and ts < timestamp '2024-01-21 00:00:00' then least(value / 100.0E0, 1.0E0) end) as post,
    100.0E0 * avg(case when ts >= timestamp '2024-01-21 00:00:00' then least(value / 100.0E0, 1.0E0) end) as retention
  from {events} group by user_id) o
where pre is not null and post is not null and retention is not null""",
    "runs": """
select o_orderkey as run_id, o_custkey as learner_id, o_orderdate as started_at, case when o_orderpriority in ('1-URGENT', '2-HIGH') then 'full' else 'baseline' end as kind,
  case when o_orderkey % 3 = 0 then 'real' else 'mock' end as mode, case when o_orderstatus = 'F' then 'failed' else 'success' end as status,
  o_totalprice / 1000.0E0 as duration, o_totalprice % 7000 as ke_ms, o_totalprice % 5000 as profiler_ms, o_totalprice % 3000 as tutor_ms
from {orders}""",
    "calls": """
select l_orderkey as run_id, concat('agent_', cast(l_suppkey % 6 as int)) as agent, l_returnflag <> 'R' as success, l_extendedprice / 10.0E0 as latency_ms, l_shipdate as called_at from {lineitem}""",
    "notes": """
select event_id as note_id, user_id as learner_id, cast(k % 20 as int) as concept_id, ts as created_at, case event_type when 'error' then 'MISCONCEPTION_NOTE' when 'view' then 'SUMMARY_NOTE' else 'ATOMIC_NOTE' end as note_type,
  concat('Insight ', event_type, ' ', cast(k as int), ' about topic ', cast(k % 7 as int)) as content
from (select *, cast(regexp_extract(props, '([0-9]+)', 1) as int) as k from {events}) e where event_type in ('view', 'click', 'error')""",
    "dialogue": """
select conv_id, turn, role, text, length(text) % 2 = 0 as is_correct from {conversations}""",
}


def needs(name_or_sql: str) -> list[str]:
    return re.findall(r"\{(\w+)\}", VIEWS.get(name_or_sql, name_or_sql))


class Views:
    """Tables and views of one data folder as DataFrames, by attribute."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        if name in TABLES:
            return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
        if name in VIEWS:
            return self.spark.sql(VIEWS[name], **{n: getattr(self, n) for n in set(needs(name))})
        raise AttributeError(name)


def oracle(sql: str) -> str:
    """`sql` with every `{view}` it names, and the views those need, as common table expressions."""
    order: list[str] = []

    def visit(text: str) -> None:
        for name in needs(text):
            if name in VIEWS and name not in order:
                visit(VIEWS[name])
                order.append(name)

    visit(sql)
    names = {n: n for n in [*TABLES, *VIEWS]}
    parts = [f"{n} as ({VIEWS[n].format(**names)})" for n in order]
    body = sql.format(**names)
    if not parts:
        return body
    extra = re.match(r"\s*with\s+(recursive\s+)?", body)
    if extra:
        return f"with {extra[1] or ''}" + ",\n".join(parts) + ",\n" + body[extra.end() :]
    return "with " + ",\n".join(parts) + "\n" + body
