"""State by bucket, and clusters, matches and misconceptions that never list the pairs of equal rows."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from scholarflow.operators import graph, resolve, text
from scholarflow.store import new_folder
from scholarflow.streaming import buckets, jobs, stateful


def attempts(spark, files):
    where = new_folder(spark, "bucket-attempts")
    rows = spark.range(400).select((F.col("id") % 40).alias("learner_id"), (F.col("id") % 3).cast("int").alias("concept_id"), F.timestamp_seconds(F.col("id") * 600).alias("ts"), F.col("id").alias("attempt_id"),
        ((F.col("id") * 7 % 11) / 10).alias("score"), F.lit(3).alias("difficulty"), F.lit("conceptual").alias("qtype"), F.lit("CARELESS").alias("err"), F.lit("APPLY").alias("bloom"))
    for k in range(files):
        rows.filter(F.floor(F.col("attempt_id") * files / 400) == k).coalesce(1).write.mode("append").parquet(where)
    return spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(where)


@pytest.mark.parametrize("job, mode, composite", [(jobs.mastery, "update", False), (jobs.sync_history, "update", False), (jobs.failures, "update", False), (stateful.alerts, "append", True), (stateful.profile, "append", True)])
def test_state_is_kept_by_bucket(spark, monkeypatch, job, mode, composite):
    monkeypatch.setattr(buckets, "BUCKETS", 2)
    if composite:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", jobs.ROCKSDB)
    else:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    query = job(attempts(spark, 1)).writeStream.option("checkpointLocation", new_folder(spark, "bucket-check")).trigger(availableNow=True).outputMode(mode).format("noop").start()
    query.awaitTermination()
    # two buckets with a few variables each, not 40 learners or 120 pairs
    assert max(s["numRowsTotal"] for p in query.recentProgress for s in p["stateOperators"]) <= 14


def test_mastery_over_batches_in_few_buckets(spark, monkeypatch):
    monkeypatch.setattr(buckets, "BUCKETS", 2)
    got = {(r["learner_id"], r["concept_id"]): (r["mastery"], r["attempts"]) for r in jobs.replay(attempts(spark, 2), jobs.mastery, new_folder(spark, "bucket-replay"), "update", ["learner_id", "concept_id"]).collect()}
    want = {}
    for k in range(400):
        m, n = want.get((k % 40, k % 3), (0.0, 0))
        score = (k * 7 % 11) / 10
        want[k % 40, k % 3] = min(1.0, max(0.0, m * jobs.CONFIG.history_weight + score * jobs.CONFIG.session_weight + jobs._step(score, "APPLY"))), n + 1
    assert got.keys() == want.keys() and all(abs(got[k][0] - want[k][0]) < 1e-12 and got[k][1] == want[k][1] for k in want)


def test_classes_cluster_and_resolve_as_their_members(spark):
    rng = np.random.default_rng(5)
    of = [int(x) for x in rng.integers(0, 12, 60)]
    least = {c: of.index(c) for c in set(of)}
    scores = {(a, b): float(rng.choice([0.3, 0.7, 0.85, 0.95])) + a / 1e4 + b / 1e6 for a in least.values() for b in least.values() if a < b}
    members = spark.createDataFrame([(least[c], k) for k, c in enumerate(of)], "cls long, node long")
    between = spark.createDataFrame([(a, b, s) for (a, b), s in scores.items()], "a long, b long, score double")
    whole = [(a, b, 1.0 if of[a] == of[b] else scores[tuple(sorted((least[of[a]], least[of[b]])))]) for a in range(60) for b in range(a + 1, 60)]
    listed = spark.createDataFrame(whole, "a long, b long, score double")
    assert sorted(map(tuple, resolve.class_clusters(members, between).collect())) == sorted(map(tuple, resolve.clusters(listed).collect()))
    matched = resolve.resolve(listed.select(F.col("b").alias("new_id"), F.col("a").alias("existing_id"), "score"))
    assert sorted(map(tuple, resolve.class_resolve(members, between).collect())) == sorted(map(tuple, matched.collect()))


def test_a_text_is_held_against_a_description_once(spark):
    answers = spark.createDataFrame([(k, 1, "CONCEPTUAL", " A red ring"[k % 2 :]) for k in range(300)] + [(900, 1, "CONCEPTUAL", None), (901, 2, "CONCEPTUAL", "x")], "id long, concept_id int, category string, text string")
    catalogue = spark.createDataFrame([(1, "CONCEPTUAL", f"K{k}", "red ring") for k in range(40)] + [(1, "CONCEPTUAL", "far", "quite another thing")], "concept_id int, category string, kind string, description string")
    df = text.misconceptions(answers, catalogue)
    got = df.groupBy("kind").count().collect()
    assert {r["kind"]: r["count"] for r in got} == {f"K{k}": 300 for k in range(40)} | {"unknown_conceptual": 1}
    # what similarity was worked out for is kept as a table: the plan that lists answers has none left to work out
    assert "levenshtein" not in df._jdf.queryExecution().optimizedPlan().toString()


def test_top_items_in_slices_of_queries(spark, monkeypatch):
    monkeypatch.setattr(resolve, "SLICE", 3)
    rng = np.random.default_rng(1)
    vec = rng.integers(-2, 3, (50, 4)).astype(float)
    items = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(vec)], "id long, vec array<double>")
    got = {}
    for r in resolve.topk_similar(items.filter("id % 5 = 0"), items, 4).collect():
        got.setdefault(r["query"], {})[r["rank"]] = r["item"]
    unit = vec / np.maximum(np.linalg.norm(vec, axis=1, keepdims=True), 1e-300)
    cos = np.round(unit @ unit.T, 9)
    for q in range(0, 50, 5):
        want = sorted((k for k in range(50) if k != q), key=lambda k: (-cos[q, k], k))[:4]
        assert [got[q][r] for r in range(1, 5)] == want


def test_delta_of_learners_with_shared_courses(spark):
    rng = np.random.default_rng(9)
    course = sorted({(int(c), int(k)) for c, k in rng.integers(0, (4, 60), (150, 2))})
    enrolled = [(int(x), int(c)) for x, c in rng.integers(0, (12, 5), (25, 2))] + [(3, None)]
    personal = sorted({(int(x), int(k)) for x, k in rng.integers(0, (14, 70), (90, 2))}) + [(None, 1)]
    wanted = {(x, k) for x, c in enrolled for d, k in course if c == d}
    want = [(x, k, "existing" if (x, k) in wanted else "deleted") for x, k in personal] + [(x, k, "new") for x, k in wanted - set(personal)]
    df = graph.sync_delta(spark.createDataFrame(course, "course_id long, concept_id long"), spark.createDataFrame(personal, "learner_id long, concept_id long"), spark.createDataFrame(enrolled, "learner_id long, course_id long"), chunk=8)
    assert sorted(map(tuple, df.select("learner_id", "concept_id", "change").collect()), key=str) == sorted(want, key=str)
    # rows that are new come out of arrays: nothing is shuffled after that
    plan = df.filter("change = 'new'")._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate explode" in plan and "Join" not in plan.split("Generate explode")[0]


def test_newest_rows_are_ranked_once_a_text(spark):
    rows = spark.createDataFrame([(f"topic {k % 3} of {k}", k // 2) for k in range(90)], "content string, date int")
    queries = spark.createDataFrame([(k, f"topic {k % 2}") for k in range(50)] + [(99, "nothing")], "query int, asked string")
    got = {}
    for r in text.newest_holding(rows, queries, 4).collect():
        got.setdefault(r["query"], set()).add((r["content"], r["date"]))
    for q in range(50):
        held = sorted(((f"topic {k % 3} of {k}", k // 2) for k in range(90) if k % 3 == q % 2), key=lambda x: (-x[1], x[0]))
        assert got[q] == set(held[:4])
    assert 99 not in got
