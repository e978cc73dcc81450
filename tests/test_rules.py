"""Golden values of the rules."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from scholarflow.functions import more_rules as S
from scholarflow.functions import rules as R
from scholarflow.operators import experiments, mastery


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


def test_gain_and_decay(spark):
    row = one(spark, R.learning_gain(F.lit(20.0), F.lit(60.0)), R.learning_gain(F.lit(50.0), F.lit(40.0)), R.learning_gain(F.lit(99.95), F.lit(100.0)), R.retention_decay(F.lit(0.5), F.lit(0.1)))
    assert list(row) == pytest.approx([0.5, -0.2, 0.0, 0.0])


def test_effect_size(spark):
    rows = spark.createDataFrame([("t", g) for g in (4.0, 5.0, 6.0)] + [("c", g) for g in (2.0, 3.0, 4.0)], "cohort string, gain double")
    row = experiments.cohens_d(rows, "gain", F.col("cohort") == "t").first()
    assert row["cohens_d"] == pytest.approx(2.0) and row["interpretation"] == "large"
    assert experiments.cohens_d(rows.filter("cohort = 't'"), "gain", F.col("cohort") == "t").first()["interpretation"] == "no data"
    assert experiments.cohens_d(rows.filter("gain in (2, 6)"), "gain", F.col("cohort") == "t").first()["interpretation"] == "insufficient sample"


def test_mastery_update(spark):
    rows = spark.createDataFrame([(1, 1, 1, 1, 0.8, "APPLY"), (2, 1, 1, 1, 0.95, "APPLY")], "learner_id long, concept_id int, ts long, attempt_id long, score double, bloom string")
    got = {r["learner_id"]: r["mastery"] for r in mastery.ewma(rows).collect()}
    assert got == {1: pytest.approx(0.24), 2: pytest.approx(0.335)}


def test_knowledge_tracing_moves_the_right_way(spark):
    rows = spark.createDataFrame([(1, 1, 1, 1, 1.0), (2, 1, 1, 1, 0.0)], "learner_id long, concept_id int, ts long, attempt_id long, score double")
    up = {r["learner_id"]: r["p_known"] for r in mastery.bkt(rows, 0.5).collect()}
    high = {r["learner_id"]: r["p_known"] for r in mastery.bkt(rows, 0.95).collect()}
    low = {r["learner_id"]: r["p_known"] for r in mastery.bkt(rows, 0.1).collect()}
    assert up[1] > 0.5 and 0.6 < high[2] < 0.95 and low[1] - 0.1 < 0.5


def test_decision_table(spark):
    t, f = F.lit(True), F.lit(False)
    rows = [(0.95, "CORRECT", f, f, f, "MASTERED"), (0.85, "CARELESS", f, f, f, "PROCEED"), (0.35, "CONCEPTUAL", t, t, f, "REMEDIATE"), (0.65, "CONCEPTUAL", t, t, f, "RETRY")]
    for m, e, severe, conceptual, persistent, want in rows:
        assert one(spark, R.decision_table(F.lit(m), F.lit(e), severe, conceptual, persistent, f))[0] == want
    assert one(spark, R.decision_table(F.lit(0.65), F.lit("CONCEPTUAL"), t, t, f, t))[0] == "ALTERNATE"


def test_times_rewards_and_priorities(spark):
    assert [one(spark, R.hours(F.lit(d), F.lit(v)))[0] for d, v in ((3, 1.0), (4, 2.0), (2, 0.5))] == pytest.approx([0.5, 0.375, 0.8])
    assert one(spark, R.reward(F.lit(0.5), F.lit(True), F.lit(0.8)))[0] == pytest.approx(0.3)
    assert one(spark, R.answer_score(F.lit(1.0), F.lit(1.0), F.lit(0.5), F.lit(" "))[0], R.answer_score(F.lit(1.0), F.lit(1.0), F.lit(0.5), F.lit(""))[1]) == (0.0, 0.9)
    assert one(spark, R.note_type(F.lit(0.85), F.lit(False), F.lit("CORRECT")), R.note_type(F.lit(0.35), F.lit(True), F.lit("CONCEPTUAL"))) == ("ATOMIC_NOTE", "MISCONCEPTION_NOTE")


def test_error_kinds(spark):
    text = F.lit("SELECT * FROM users")
    typo = F.lit("SELEC * FROM users")
    assert one(spark, S.careless(typo, text, R.edit_similarity(typo, text)), S.procedural(typo, text), S.careless(F.lit("a 12"), F.lit("b 13"), F.lit(0.1)), S.careless(F.lit("a 12"), F.lit("b 14"), F.lit(0.1))) == (True, True, True, False)
    kind = lambda s, sim, known: one(spark, S.error_type(F.lit(s), F.lit(True), F.lit(False), F.lit(sim), F.lit(known)))[0]
    assert [kind(0.98, 1.0, False), kind(0.85, 0.9, False), kind(0.25, 0.1, True), kind(0.25, 0.1, False)] == ["CORRECT", "CARELESS", "CONCEPTUAL", "PROCEDURAL"]


def test_names(spark):
    assert one(spark, R.sanitize(F.lit("SELECT Statement")), R.sanitize(F.lit("--SQL-JOIN!")), R.concept_code(F.lit(None), F.lit("A b"))) == ("select_statement", "sql_join", "general.a_b")
    assert one(spark, *S.normalize_context(F.lit("Big Data ETL Flow, weekly"))) == ("big_data_etl", 3, "flow,weekly")
    assert one(spark, *S.parse_code(F.lit("sql.select"))) == ("sql", "concept", "select")
    assert one(spark, R.word_jaccard(F.lit(""), F.lit("")))[0] == 0.0


def test_upsert_is_idempotent(spark):
    from scholarflow.operators import graph

    old = spark.createDataFrame([(1, "a", "long text", [1]), (2, "b", "x", [1, 2])], "concept_id long, name string, description string, docs array<long>")
    new = spark.createDataFrame([(1, None, "short", [3]), (3, "c", None, [3])], "concept_id long, name string, description string, docs array<long>")
    once = graph.upsert_concepts(old, new)
    assert sorted(map(tuple, once.collect())) == sorted(map(tuple, graph.upsert_concepts(once, new).collect()))
    assert {r["concept_id"]: (r["name"], r["description"], r["docs"]) for r in once.collect()}[1] == ("a", "long text", [1, 3])
    assert graph.remove_provenance(once, 3).count() == 2
