"""Greedy paths against a search through all concepts."""

from __future__ import annotations

import random

import pytest

from scholarflow.operators.resolve import greedy_paths
from scholarflow.plans.views import Views


def _slow(mastery, concepts, budget):
    out = set()
    for learner in {x for x, _, _ in mastery}:
        level = {c: m for x, c, m in mastery if x == learner}
        gain = {c: (1 - level.get(c, 0.0)) * (1 - abs(d / 5.0 - 0.5)) for c, d, t in concepts if d is not None and t and level.get(c, 0.0) < 0.9}
        hours = {c: t / 60 for c, _, t in concepts if t}
        used = pos = 0
        for c in sorted(gain, key=lambda c: (-gain[c], c)):
            if used < 0.8 * budget and used + hours[c] <= budget and gain[c] > 0:
                out.add((learner, pos, c, round(used, 9)))
                used, pos = used + hours[c], pos + 1
    return out


@pytest.mark.parametrize("light", [0, 3, 200])
def test_paths_equal_a_full_search(spark, light):
    rng = random.Random(5)
    concepts = [(k, rng.choice([1, 2, 3, 4, 5, None]), rng.choice([20, 45, 90, 200, 400, None, 0])) for k in range(150)]
    mastery = [(x, k, rng.choice([0.0, 0.2, 0.5, 0.95])) for x in range(12) for k in rng.sample(range(170), x * 10)] + [(99, 9999, 0.1)]
    got = greedy_paths(spark.createDataFrame(mastery, "learner_id long, concept_id long, level double"), spark.createDataFrame(concepts, "concept_id long, difficulty int, time_estimate int"), 7.0, light)
    assert {(r["learner_id"], r["pos"], r["concept_id"], round(r["hours_before"], 9)) for r in got.collect()} == _slow(mastery, concepts, 7.0)


def test_query_equals_a_full_search(spark, sf_dir):
    v = Views(spark, sf_dir)
    mastery = [tuple(r) for r in v.mastery.select("learner_id", "concept_id", "level").collect()]
    concepts = [tuple(r) for r in v.concepts.select("concept_id", "difficulty", "time_estimate").collect()]
    got = greedy_paths(v.mastery, v.concepts, 20.0)
    assert {(r["learner_id"], r["pos"], r["concept_id"], round(r["hours_before"], 9)) for r in got.collect()} == _slow(mastery, concepts, 20.0)


def test_no_rows(spark):
    none = spark.createDataFrame([], "learner_id long, concept_id long, level double")
    concepts = spark.createDataFrame([(1, 2, 30)], "concept_id long, difficulty int, time_estimate int")
    assert greedy_paths(none, concepts, 7.0).count() == 0
