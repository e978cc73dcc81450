"""Bootstrap intervals against numpy, and joins of notes against loops."""

from __future__ import annotations

from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from scholarflow.operators import experiments, mastery


def test_bootstrap_interval_is_that_of_numpy(spark):
    rng = np.random.default_rng(1)
    a, b = np.round(rng.normal(0.6, 0.2, 300), 2), np.round(rng.normal(0.5, 0.2, 260), 2)

    def d(x, y):
        return (x.mean() - y.mean()) / np.sqrt((((x - x.mean()) ** 2).sum() + ((y - y.mean()) ** 2).sum()) / (len(x) + len(y) - 2))

    draws = [d(rng.choice(a, len(a)), rng.choice(b, len(b))) for _ in range(10_000)]
    rows = [(float(x), True) for x in a] + [(float(x), False) for x in b] + [(None, True), (0.5, None)]
    df = spark.createDataFrame(rows, "x double, t boolean")
    got = experiments.bootstrap_ci(df.repartition(4), "x", F.col("t")).first()
    # the interval is about 0.34 wide; both ends have a standard error of about 0.004
    for have, want in zip(got, np.percentile(draws, [2.5, 50, 97.5]), strict=True):
        assert abs(have - want) < 0.02
    again = experiments.bootstrap_ci(df.repartition(2), "x", F.col("t")).first()
    assert all(abs(x - y) < 1e-9 for x, y in zip(got, again, strict=True))
    assert experiments.bootstrap_ci(df.filter("t"), "x", F.col("t")).first()["low"] is None


def test_notes_of_a_hot_learner_meet_few(spark):
    notes = [(k, 1 if k < 400 else k % 5, k % 3) for k in range(500)]
    edges = [(0, 1), (1, 2), (2, 2), (0, 1)]
    n = spark.createDataFrame(notes, "note_id long, learner_id long, concept_id int")
    e = spark.createDataFrame(edges, "source int, target int")
    pairs = [(x, y) for x in notes for s, t in edges if s == x[2] for y in notes if y[1] == x[1] and y[2] == t and y[0] != x[0]]
    counts = Counter((x[1], y[2]) for x, y in pairs)
    assert {(r["learner_id"], r["other"]): r["n"] for r in mastery.note_synthesis(n, e).collect()} == counts
    near = {}
    for x, y in pairs:
        near.setdefault(x[0], set()).add(y[0])
    got = {(r["note_id"], r["rank"]): r["linked"] for r in mastery.related_notes(n, e).collect()}
    assert got == {(k, i): y for k, found in near.items() for i, y in enumerate(sorted(found)[:5], 1)}
