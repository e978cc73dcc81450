"""Domains, contexts, resources, paragraphs and staged extractions on small made-up rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from scholarflow.operators import graph, planning, text
from scholarflow.sources import tables


def test_domain_scores(spark):
    domains = spark.createDataFrame([("sql", "Databases", ["join", "table"], 1), ("ml", "Machine Learning", ["model", "table"], 2)], "code string, display_name string, keywords array<string>, ordinal int")
    texts = [(1, "SQL join"), (2, "machine learning with a MODEL"), (3, "a table"), (4, "nothing"), (5, None), (6, ""), (3, "a table")]
    got = sorted((r["id"], r["domain"], r["score"]) for r in text.suggest_domains(spark.createDataFrame(texts, "id long, text string"), domains).collect())
    assert got == [(1, "sql", 12), (2, "ml", 10), (3, "sql", 2), (3, "sql", 2), (4, None, 0), (5, None, 0), (6, None, 0)]


def test_first_keyword_wins(spark):
    words = spark.createDataFrame([("deep", "dl", 2), ("learning", "ml", 1)], "keyword string, domain string, ordinal int")
    titles = spark.createDataFrame([(1, "Deep Learning"), (2, "Deep water"), (3, "Cooking"), (4, None)], "id long, title string")
    assert {r["id"]: r["domain"] for r in text.keyword_domains(titles, words).collect()} == {1: "ml", 2: "dl", 3: "general", 4: "general"}


def test_contexts_resolve_or_are_suggested(spark):
    registry = [("db", "sql_queries", ["queries"], 1), ("db", "sql_joins", None, 2), ("db", "sql_windows", [], 3), ("db", "table_joins", [], 4), ("web", "sql_joins", [], 1)]
    inputs = [(1, "db", "SQL-Queries!"), (2, "db", "queries"), (3, "db", "sql tuning"), (4, "db", "hash joins"), (5, "web", "queries"), (6, "none", "sql joins"), (7, "db", None), (8, None, "sql joins")]
    got = text.resolve_contexts(spark.createDataFrame(inputs, "id long, domain string, context string"), spark.createDataFrame(registry, "domain string, context_key string, aliases array<string>, ordinal int"))
    rows = {r["id"]: (r["context_key"], r["suggestions"], r["needs_refine"]) for r in got.collect()}
    assert rows[1] == ("sql_queries", "", False) and rows[2] == ("sql_queries", "", True)
    assert rows[3] == (None, "sql_queries,sql_joins,sql_windows", False) and rows[4] == (None, "sql_joins,table_joins", False)
    assert rows[5] == (None, "", True) and rows[6] == (None, "", False) and rows[7] == (None, "", True) and rows[8] == (None, "", False)


def test_resources_follow_the_style(spark):
    steps = spark.createDataFrame([(1, 7, "joins", 4, "READING"), (2, 7, "joins", 4, None), (3, 7, "joins", 1, "AUDITORY")], "learner_id long, concept_id long, name string, difficulty int, style string")
    got = {(r["learner_id"], r["kind"]): (r["primary_type"], r["priority"], r["description"]) for r in planning.recommend_resources(steps).collect()}
    assert len(got) == 9
    assert got[1, "ARTICLE"] == ("ARTICLE", 2, "Detailed article on joins") and got[1, "VIDEO"][1] == 2
    assert got[2, "VIDEO"] == ("VIDEO", 1, "Video tutorial on joins") and got[3, "EXERCISE"][:2] == ("TUTORIAL", 1) and got[3, "ARTICLE"][1] == 3


def test_commits_merge_and_recover(spark, tmp_path):
    where = str(tmp_path / "graph")
    rows = lambda x: spark.createDataFrame(x, "concept_id long, name string")
    tables.stage(rows([(1, "a"), (2, "b")]), where, "x")
    tables.commit(spark, where, "x", "concept_id")
    tables.stage(rows([(2, "B"), (3, "c")]), where, "y")
    (tmp_path / "graph" / "published").rename(tmp_path / "graph" / "before")  # as a commit leaves it that died between its renames
    tables.commit(spark, where, "y", "concept_id")
    assert sorted(map(tuple, tables.published(spark, where).collect())) == [(1, "a"), (2, "B"), (3, "c")]
    assert sorted(p.name for p in (tmp_path / "graph").iterdir()) == ["published", "staging"] and not any((tmp_path / "graph" / "staging").iterdir())


def test_paragraphs_keep_every_letter(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    parts = text.paragraphs(docs)
    bare = lambda c: F.regexp_replace(c, r"\s+", "")
    longest = {r["level"]: r["n"] for r in parts.groupBy("level").agg(F.max(F.length("text")).alias("n")).collect()}
    joined = parts.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("idx", "text"))), lambda x: x["text"]), "").alias("got"))
    lost = docs.filter("trim(text) <> ''").join(joined, "doc_id", "left").filter(~F.coalesce(bare(F.col("got")) == bare(F.col("text")), F.lit(False)))
    assert lost.count() == 0 and all(longest.get(level, 0) <= n for level, n in ((2, 4000), (3, 4000), (4, 2000)))


def test_validation_counts_equal_the_issues(spark):
    nodes = spark.createDataFrame([("a", "A", "long enough text", 2, 30, "APPLY", 1), ("a", "A", None, 9, 5, "guess", 2), (None, "x", "long enough text", None, None, None, 3), ("b c", "", "short", 1, 20, "apply", 4)], "concept_id string, name string, description string, difficulty int, time_estimate int, bloom string, pos int")
    edges = spark.createDataFrame([("a", "a", "NEXT", 0.5), ("a", "z", "LIKES", 2.0), ("a", "z", "LIKES", 2.0), (None, "a", "NEXT", None)], "source string, target string, rel_type string, weight double")
    got = {r["rule"]: r["issues"] for r in graph.validate(nodes, edges).collect()}
    found = graph.node_issues(nodes) | graph.edge_issues(edges, nodes)
    assert got == {rule: n for rule, n in ((rule, rows.count()) for rule, rows in found.items()) if n}
    assert got["unique"] == 1 and got["ref_exists"] == 2 and got["rel_type"] == 2 and got["self_loop"] == 1 and got["orphans"] == 2
