"""The concept graph: neighbourhoods, closures, cycles, health, and curation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import RELATIONS
from ..store import checkpointed
from .components import components


def prerequisite_closure(edges: DataFrame, hops: int = 3) -> DataFrame:
    """(concept_id, prerequisite, depth): all prerequisites within some hops, at their least depth."""
    need = edges.filter("rel_type = 'REQUIRES'").select("source", "target").distinct()
    level = need.select(F.col("source").alias("concept_id"), F.col("target").alias("prerequisite"))
    out = level.withColumn("depth", F.lit(1))
    for d in range(2, hops + 1):
        level = level.join(need, F.col("prerequisite") == F.col("source")).select("concept_id", F.col("target").alias("prerequisite")).distinct()
        out = out.unionAll(level.withColumn("depth", F.lit(d)))
    return out.groupBy("concept_id", "prerequisite").agg(F.min("depth").alias("depth"))


def alternatives(edges: DataFrame) -> DataFrame:
    """Similar concepts, in either direction."""
    e = edges.filter("rel_type = 'SIMILAR_TO'").select("source", "target")
    return e.unionAll(e.select(F.col("target"), F.col("source"))).distinct().select(F.col("source").alias("concept_id"), F.col("target").alias("alternative"))


def reachable(edges: DataFrame, limit: int = 5) -> DataFrame:
    e = edges.filter("rel_type in ('NEXT', 'IS_PREREQUISITE_OF', 'SIMILAR_TO')").select("source", "target").distinct()
    return e.withColumn("rank", F.row_number().over(Window.partitionBy("source").orderBy("target"))).filter(F.col("rank") <= limit)


def induced(edges: DataFrame, chosen: DataFrame) -> DataFrame:
    """Edges with both ends in `chosen` (concept_id)."""
    a, b = chosen.select(F.col("concept_id").alias("source")), chosen.select(F.col("concept_id").alias("target"))
    return edges.join(a, "source", "left_semi").join(b, "target", "left_semi")


def touching(edges: DataFrame, chosen: DataFrame) -> DataFrame:
    """Edges with an end in `chosen` (concept_id)."""
    a, b = chosen.select(F.col("concept_id").alias("source")), chosen.select(F.col("concept_id").alias("target"))
    return edges.join(a, "source", "left_semi").unionByName(edges.join(b, "target", "left_semi")).distinct()


def relationship_map(edges: DataFrame) -> DataFrame:
    targets = F.array_join(F.transform(F.array_sort(F.collect_set("target")), lambda x: x.cast("string")), ",")
    return edges.groupBy("rel_type", "source").agg(F.count(F.lit(1)).alias("n"), targets.alias("targets"))


def concept_context(concepts: DataFrame, edges: DataFrame) -> DataFrame:
    """Each concept with its neighbours by type, aggregated before the join so that lists don't multiply."""
    by = edges.groupBy(F.col("source").alias("concept_id")).agg(
        *[F.array_join(F.transform(F.array_sort(F.collect_set(F.when(F.col("rel_type") == t, F.col("target")))), lambda x: x.cast("string")), ",").alias(n) for t, n in (("REQUIRES", "prerequisites"), ("SIMILAR_TO", "similar"), ("REMEDIATES", "remedies"))]
    )
    return concepts.select("concept_id", "name").join(by, "concept_id", "left").na.fill("", ["prerequisites", "similar", "remedies"])


def personal_subgraph(mastery: DataFrame, edges: DataFrame) -> DataFrame:
    """Concepts each learner knows, or that are next to one."""
    known = mastery.select("learner_id", F.col("concept_id").cast("long").alias("concept_id"))
    near = known.join(edges.select(F.col("source").alias("concept_id"), "target"), "concept_id").select("learner_id", F.col("target").alias("concept_id"))
    return known.unionByName(near).distinct()


def node_inventory(concepts: DataFrame) -> DataFrame:
    return concepts.groupBy("kind").agg(F.count(F.lit(1)).alias("nodes"))


def relation_inventory(edges: DataFrame) -> DataFrame:
    return edges.groupBy("rel_type").agg(F.count(F.lit(1)).alias("edges"), F.avg("weight").alias("avg_weight"))


def centrality(edges: DataFrame, limit: int = 50) -> DataFrame:
    e = edges.filter("rel_type = 'REQUIRES'")
    ends = e.select(F.col("source").alias("concept_id")).unionAll(e.select("target"))
    return ends.groupBy("concept_id").agg(F.count(F.lit(1)).alias("degree")).orderBy(F.desc("degree"), "concept_id").limit(limit)


def health(concepts: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes, edges, orphans, mean degree and a score of 100 points with its band."""
    ends = edges.select(F.col("source").alias("concept_id")).unionAll(edges.select("target")).distinct()
    n = concepts.agg(F.count(F.lit(1)).alias("nodes"))
    orphans = concepts.select("concept_id").join(ends, "concept_id", "left_anti").agg(F.count(F.lit(1)).alias("orphans"))
    out = n.join(F.broadcast(edges.agg(F.count(F.lit(1)).alias("edges")))).join(F.broadcast(orphans))  # one row each
    out = out.withColumn("avg_degree", 2 * F.col("edges") / F.col("nodes")).withColumn("orphan_pct", 100 * F.col("orphans") / F.col("nodes"))
    score = F.when(F.col("nodes") > 0, 20).otherwise(0) + F.when(F.col("edges") > 0, 20).otherwise(0) + F.when(F.col("orphan_pct") < 5, 30).otherwise(0) + F.when(F.col("avg_degree") >= 2, 30).otherwise(0)
    return out.withColumn("score", score).withColumn("status", F.when(score >= 80, "HEALTHY").when(score >= 50, "FAIR").otherwise("POOR"))


def easiest_roots(concepts: DataFrame, edges: DataFrame, limit: int = 10) -> DataFrame:
    needs = edges.filter("rel_type = 'REQUIRES'").select(F.col("source").alias("concept_id"))
    return concepts.join(needs, "concept_id", "left_anti").orderBy("difficulty", "concept_id").limit(limit).select("concept_id", "name", "difficulty")


def peel_cycles(edges: DataFrame, kinds: tuple[str, ...] = ("REQUIRES", "NEXT", "IS_SUB_CONCEPT_OF"), rounds: int = 8) -> DataFrame:
    """(source, target, component): the edges that lie on a cycle or between cycles, and their part's least node.

    Nodes without an edge in or out are peeled off until none is left, whatever that takes. Peeling eats one
    node from each end of a chain in a round, so after `rounds` rounds every chain of nodes with one edge in
    and one out becomes a single node: long chains go in a few rounds, and a ring becomes a loop, which stays.
    Edges are checkpointed, and one count a round reaches the driver.
    """
    all_edges = checkpointed(edges.filter(F.col("rel_type").isin(*kinds)).select("source", "target").distinct())
    e, names = all_edges, None
    while True:
        e, done = _peel(e, rounds)
        if done:
            break
        e, merged = _contract(e)
        merged = merged.select("node", F.col("component").alias("name"))
        if names is None:
            names = merged
        else:
            old = names.join(merged.select(F.col("node").alias("name"), F.col("name").alias("newer")), "name", "left").select("node", F.coalesce("newer", "name").alias("name"))
            names = checkpointed(old.unionByName(merged.join(names.select("node"), "node", "left_anti")))
    if names is None:
        left = e
    else:
        name = lambda end: names.select(F.col("node").alias(end), F.col("name").alias(f"{end}_name"))
        named = all_edges.join(name("source"), "source", "left").join(name("target"), "target", "left")
        named = named.withColumns({f"{end}_name": F.coalesce(f"{end}_name", end) for end in ("source", "target")})
        alive = e.select(F.col("source").alias("source_name"), F.col("target").alias("target_name")).unionByName(e.select(F.col("source").alias("source_name"), F.col("source").alias("target_name")))
        left = checkpointed(named.join(alive.distinct(), ["source_name", "target_name"], "left_semi").select("source", "target"))
    parts = components(left, "source", "target").select(F.col("node").alias("source"), "component")
    return left.join(parts, "source", "left").select("source", "target", F.coalesce("component", "source").alias("component"))


def _peel(e: DataFrame, rounds: int) -> tuple[DataFrame, bool]:
    """`e` after at most `rounds` rounds of peeling, and whether nothing more can be peeled."""
    n = e.count()
    for _ in range(rounds):
        e = e.join(e.select(F.col("source").alias("target")).distinct(), "target", "left_semi").join(e.select(F.col("target").alias("source")).distinct(), "source", "left_semi")
        e = checkpointed(e.select("source", "target"))
        left = e.count()
        if left in (0, n):
            return e, True
        n = left
    return e, False


def _contract(e: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Edges with each chain of nodes that have one edge in and one out as a single node, and (node, component) of the chains."""
    one = lambda end, other: e.groupBy(F.col(end).alias("node")).agg(F.count(F.lit(1)).alias(other)).filter(f"{other} = 1").select("node")
    plain = checkpointed(one("source", "outs").join(one("target", "ins"), "node"))
    inner = e.join(plain.select(F.col("node").alias("source")), "source", "left_semi").join(plain.select(F.col("node").alias("target")), "target", "left_semi")
    inner = checkpointed(inner.select("source", "target"))
    chains = checkpointed(components(inner, "source", "target"))
    label = lambda end: chains.select(F.col("node").alias(end), F.col("component").alias(f"{end}_c"))
    rest = e.join(inner, ["source", "target"], "left_anti").join(label("source"), "source", "left").join(label("target"), "target", "left")
    rest = rest.select(F.coalesce("source_c", "source").alias("source"), F.coalesce("target_c", "target").alias("target"))
    # a ring has as many edges as nodes
    edges_of = inner.filter("source <> target").join(label("source"), "source").groupBy("source_c").agg(F.count(F.lit(1)).alias("k"))
    nodes_of = chains.groupBy("component").agg(F.count(F.lit(1)).alias("n"))
    rings = edges_of.join(nodes_of, (F.col("source_c") == F.col("component")) & (F.col("k") == F.col("n"))).select(F.col("component").alias("source"), F.col("component").alias("target"))
    loops = inner.filter("source = target")
    return checkpointed(rest.unionByName(rings).unionByName(loops).distinct()), chains


# --- curation -------------------------------------------------------------------------------------


def upsert_concepts(old: DataFrame, new: DataFrame) -> DataFrame:
    """Merge by concept_id: new values win unless null, the longer description wins, documents are united."""
    o, n = old.alias("o"), new.alias("n")
    both = o.join(n, F.col("o.concept_id") == F.col("n.concept_id"), "full_outer")
    longer = F.when(F.coalesce(F.length("n.description"), F.lit(-1)) > F.coalesce(F.length("o.description"), F.lit(-1)), F.col("n.description")).otherwise(F.col("o.description"))
    docs = F.array_sort(F.array_union(F.coalesce("o.docs", F.array().cast("array<bigint>")), F.coalesce("n.docs", F.array().cast("array<bigint>"))))
    return both.select(F.coalesce("n.concept_id", "o.concept_id").alias("concept_id"), F.coalesce("n.name", "o.name").alias("name"), longer.alias("description"), docs.alias("docs"))


def upsert_edges(old: DataFrame, new: DataFrame, concepts: DataFrame) -> DataFrame:
    """Merge by (source, target, rel_type); new weights win, and both ends must exist."""
    key = ["source", "target", "rel_type"]
    valid = induced(new, concepts)
    both = old.select(*key, F.col("weight").alias("w_old")).join(valid.select(*key, F.col("weight").alias("w_new")), key, "full_outer")
    return both.select(*key, F.coalesce("w_new", "w_old").alias("weight"))


def remove_provenance(concepts: DataFrame, doc: int) -> DataFrame:
    """Concepts without `doc` in their docs; those with no document left are gone."""
    return concepts.withColumn("docs", F.array_remove("docs", doc)).filter(F.size("docs") > 0)


def union_edges(old: DataFrame, new: DataFrame, mapping: DataFrame) -> DataFrame:
    """Old edges and new ones with merged ids replaced, without loops, one of each kind, old first."""
    m = mapping.select(F.col("from_id"), F.col("to_id"))
    e = new.join(m.select(F.col("from_id").alias("source"), F.col("to_id").alias("s2")), "source", "left").join(m.select(F.col("from_id").alias("target"), F.col("to_id").alias("t2")), "target", "left")
    e = e.select(F.coalesce("s2", "source").alias("source"), F.coalesce("t2", "target").alias("target"), "rel_type", "weight", F.lit(1).alias("p"))
    rows = old.select("source", "target", "rel_type", "weight", F.lit(0).alias("p")).unionByName(e).filter("source <> target")
    return rows.groupBy("source", "target", "rel_type").agg(F.min_by("weight", F.struct("p", "weight")).alias("weight"))


def canonical(snapshots: DataFrame, keys: list[str]) -> DataFrame:
    """The best committed snapshot of each key: highest confidence, then latest upload, then a fixed order."""
    order = [F.desc("confidence"), F.desc("uploaded_at"), "doc_id", "line", "order_id", "supp_id", "price", "quantity"]
    live = snapshots.filter("status = 'COMMITTED'")
    return live.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter("_r = 1").drop("_r")


def affected(old: DataFrame, new: DataFrame) -> DataFrame:
    return old.select("concept_id").union(new.select("concept_id")).distinct()


def sync_delta(course: DataFrame, personal: DataFrame, enrolled: DataFrame, chunk: int = 4096) -> DataFrame:
    """Per learner: concepts of their courses that are new, kept, or deleted against the personal ones.

    course: (course_id, concept_id); personal: (learner_id, concept_id); enrolled: (learner_id, course_id). A learner meets
    the concepts of their own courses only, each once. What learners lack is about learners times concepts, so those rows are never shuffled:
    learners with the same set of courses share its concepts, cut into arrays of about `chunk`, and each array meets a learner's own concepts
    of that chunk in one row, which is opened where it is formed.
    """
    plan = enrolled.filter("course_id is not null").groupBy("learner_id").agg(F.array_sort(F.collect_set("course_id")).alias("courses"))
    plan = checkpointed(plan.select("learner_id", "courses", F.xxhash64("courses").alias("plan")))
    plans = plan.select("plan", "courses").distinct().select("plan", "courses", F.explode("courses").alias("course_id"))
    wanted = checkpointed(plans.join(course, "course_id").select("plan", "courses", "concept_id").distinct())
    cut = wanted.groupBy("plan", "courses").agg(F.ceil(F.count(F.lit(1)) / chunk).cast("int").alias("chunks"))
    part = F.pmod(F.xxhash64("concept_id"), F.col("chunks")).cast("int").alias("part")
    arrays = wanted.join(cut, ["plan", "courses"]).groupBy("plan", "courses", part).agg(F.collect_list("concept_id").alias("concepts"), F.max(F.col("concept_id").isNull()).alias("bare"))

    # on the side of what learners have, rows are as many as those
    has = personal.select("learner_id", "concept_id").join(plan, "learner_id", "left")
    has = checkpointed(has.join(wanted.withColumn("c", F.lit(1)), ["plan", "courses", "concept_id"], "left").select("learner_id", "plan", "courses", "concept_id", "c"))
    old = has.select("learner_id", "concept_id", F.when(F.col("c").isNull(), "deleted").otherwise("existing").alias("change"))

    own = has.filter("c is not null").join(cut, ["plan", "courses"]).groupBy("learner_id", part).agg(F.collect_set("concept_id").alias("own"))
    meets = plan.join(cut, ["plan", "courses"]).select("learner_id", "plan", "courses", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("part"))
    meets = meets.join(own, ["learner_id", "part"], "left").join(arrays, ["plan", "courses", "part"])
    lacks = F.when(F.col("own").isNull(), F.col("concepts")).otherwise(F.array_except("concepts", "own"))
    new = meets.select("learner_id", F.explode(lacks).alias("concept_id"))
    new = new.unionByName(meets.filter("bare").select("learner_id", F.lit(None).cast(course.schema["concept_id"].dataType).alias("concept_id")))
    return old.unionByName(new.withColumn("change", F.lit("new")))


# --- validation -----------------------------------------------------------------------------------


def _node_rules() -> dict[str, tuple[str, Column, Column]]:
    """Rules on one node: severity, what is wrong, and how an issue names the node."""
    c = F.col
    blank = lambda x: F.trim(F.coalesce(c(x).cast("string"), F.lit(""))) == ""
    outside = lambda x, low, high: ~F.coalesce(c(x).between(low, high), F.lit(False))
    ident = c("concept_id").cast("string")
    return {
        "required": ("ERROR", blank("concept_id") | blank("name"), c("pos").cast("string")),
        "id_format": ("WARNING", ~blank("concept_id") & ~ident.rlike("^[A-Za-z0-9_]+$"), ident),
        "bloom_enum": ("WARNING", ~F.coalesce(F.upper("bloom").isin("REMEMBER", "UNDERSTAND", "APPLY", "ANALYZE", "EVALUATE", "CREATE"), F.lit(True)), ident),
        "difficulty": ("WARNING", outside("difficulty", 1, 5), ident),
        "time_range": ("WARNING", outside("time_estimate", 15, 120), ident),
        "description": ("WARNING", F.coalesce(F.length("description"), F.lit(0)) < 10, ident),
    }


def _edge_rules() -> dict[str, tuple[str, Column, Column]]:
    """Rules on one edge, as in `_node_rules`."""
    ident = F.concat_ws(">", F.col("source").cast("string"), F.col("target").cast("string"), "rel_type")
    return {
        "self_loop": ("ERROR", F.coalesce(F.col("source") == F.col("target"), F.lit(False)), ident),
        "rel_type": ("WARNING", ~F.coalesce(F.col("rel_type").isin(*RELATIONS), F.lit(True)), ident),
        "weight": ("WARNING", ~F.coalesce(F.col("weight").between(0, 1), F.lit(False)), ident),
    }


def _issues(rows: DataFrame, rules: dict[str, tuple[str, Column, Column]]) -> dict[str, DataFrame]:
    return {rule: rows.filter(wrong).select(F.lit(rule).alias("rule"), F.lit(severity).alias("severity"), ident.alias("item")) for rule, (severity, wrong, ident) in rules.items()}


def node_issues(nodes: DataFrame) -> dict[str, DataFrame]:
    """Rules over nodes (concept_id, name, description, difficulty, time_estimate, bloom, pos)."""
    dup = nodes.withColumn("r", F.row_number().over(Window.partitionBy("concept_id").orderBy("pos"))).filter("r > 1")
    return _issues(nodes, _node_rules()) | _issues(dup, {"unique": ("ERROR", F.lit(True), F.col("concept_id").cast("string"))})


def _lost(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Distinct edges with an end that is no node."""
    known = nodes.select(F.col("concept_id").alias("_end")).distinct()
    ends = edges.distinct().withColumn("_end", F.explode(F.array_distinct(F.array("source", "target"))))
    return ends.join(known, "_end", "left_anti").drop("_end").distinct()


def _orphans(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    ends = edges.select(F.explode(F.array("source", "target")).alias("concept_id")).distinct()
    return nodes.select("concept_id").join(ends, "concept_id", "left_anti")


def edge_issues(edges: DataFrame, nodes: DataFrame) -> dict[str, DataFrame]:
    """Rules over edges (source, target, rel_type, weight) against nodes (concept_id)."""
    rules = _edge_rules()
    lost = {"ref_exists": ("ERROR", F.lit(True), rules["rel_type"][2])}
    orphans = {"orphans": ("WARNING", F.lit(True), F.col("concept_id").cast("string"))}
    return _issues(edges, rules) | _issues(_lost(edges, nodes), lost) | _issues(_orphans(edges, nodes), orphans)


def validate(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """All issues of a graph, counted by rule: (rule, severity, issues), rules without an issue left out.

    Rules on single rows are counted in one pass over the nodes and one over the edges, with nothing to shuffle
    but a row a task; repeated ids, lost ends and orphans are one grouping or join each.
    """

    def counted(rows: DataFrame, rules: dict[str, tuple[str, Column, Column]]) -> DataFrame:
        sums = rows.agg(*[F.count_if(wrong).alias(rule) for rule, (_, wrong, _) in rules.items()])
        return sums.select(F.inline(F.array(*[F.struct(F.lit(rule).alias("rule"), F.lit(severity).alias("severity"), F.col(rule).alias("issues")) for rule, (severity, _, _) in rules.items()])))

    def number(rows: DataFrame, rule: str, severity: str, issues: Column) -> DataFrame:
        return rows.agg(issues.alias("issues")).select(F.lit(rule).alias("rule"), F.lit(severity).alias("severity"), "issues")

    repeats = nodes.groupBy("concept_id").agg((F.count(F.lit(1)) - 1).alias("n"))
    every = F.count(F.lit(1))
    out = counted(nodes, _node_rules()).unionAll(counted(edges, _edge_rules())).unionAll(number(repeats, "unique", "ERROR", F.sum("n")))
    out = out.unionAll(number(_lost(edges, nodes), "ref_exists", "ERROR", every)).unionAll(number(_orphans(edges, nodes), "orphans", "WARNING", every))
    return out.filter("issues > 0")


def autofix_nodes(nodes: DataFrame) -> DataFrame:
    return nodes.withColumns(
        {
            "concept_id": F.regexp_replace(F.col("concept_id").cast("string"), "[^A-Za-z0-9_]", "_"),
            "bloom": F.when(F.upper("bloom").isin("REMEMBER", "UNDERSTAND", "APPLY", "ANALYZE", "EVALUATE", "CREATE"), F.upper("bloom")).otherwise("UNDERSTAND"),
            "difficulty": F.least(F.lit(5), F.greatest(F.lit(1), F.coalesce("difficulty", F.lit(2)))), "time_estimate": F.least(F.lit(120), F.greatest(F.lit(15), F.coalesce("time_estimate", F.lit(30)))),
        }
    )


def autofix_edges(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    kept = induced(edges.filter("source <> target"), nodes)
    return kept.withColumn("rel_type", F.when(F.col("rel_type").isin(*RELATIONS), F.col("rel_type")).otherwise("SIMILAR_TO"))
