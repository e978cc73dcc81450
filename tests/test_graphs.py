"""Cycles, components and clusters against brute force."""

from __future__ import annotations

import random

import numpy as np
from pyspark.sql import functions as F

from scholarflow.operators import graph, planning, resolve, text
from scholarflow.operators.components import components


def _on_or_between(edges):
    left = set(edges)
    while True:
        sources, targets = {s for s, _ in left}, {t for _, t in left}
        new = {(s, t) for s, t in left if t in sources and s in targets}
        if new == left:
            return left
        left = new


def _parts(edges):
    root = {x: x for e in edges for x in e}

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        x, y = top(a), top(b)
        root[max(x, y)] = min(x, y)
    return {x: top(x) for x in root}


def test_components_of_a_long_chain(spark):
    df = spark.range(1, 501).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    assert components(df).filter("component <> 1").count() == 0 and components(df).count() == 501
    assert components(df.limit(0)).count() == 0


def test_cycles_match_peeling(spark):
    rng = random.Random(3)
    edges = {(i, i + 1) for i in range(1000, 1500)}  # a chain, which goes
    edges |= {(i, i + 1) for i in range(2000, 2040)} | {(2040, 2000)}  # a ring
    edges |= {(2040, 3000), (3000, 3001), (3001, 3002), (3002, 4000), (4000, 4001), (4001, 4000)}  # a bridge between cycles
    edges |= {(5000, 5000), (2000, 1400), (900, 2000)}
    edges |= {(rng.randrange(100), rng.randrange(100)) for _ in range(90)}
    df = spark.createDataFrame(sorted(edges), "source long, target long").withColumn("rel_type", F.lit("NEXT"))
    got = {(r["source"], r["target"]): r["component"] for r in graph.peel_cycles(df).collect()}
    want = _on_or_between(edges)
    parts = _parts(want)
    assert got == {e: parts[e[0]] for e in want}
    assert graph.peel_cycles(df.filter("source between 1000 and 1499")).count() == 0 and graph.peel_cycles(df.limit(0)).count() == 0


def test_clusters_by_average_linkage(spark):
    rng = np.random.default_rng(4)
    pairs = [(i, j, float(s)) for i in range(12) for j in range(i + 1, 12) if (s := round(float(rng.uniform(0.5, 1)), 3)) > 0.55]
    s = np.zeros((12, 12))
    for i, j, v in pairs:
        s[i, j] = s[j, i] = v
    groups = [[k] for k in range(12)]
    while True:
        best = max(((s[np.ix_(a, b)].mean(), -x, -y) for x, a in enumerate(groups) for y, b in enumerate(groups) if x < y), default=(0, 0, 0))
        if best[0] < 0.8:
            break
        groups[-best[1]] += groups.pop(-best[2])
    got = {r["node"]: r["cluster"] for r in resolve.clusters(spark.createDataFrame(pairs, "a long, b long, score double")).collect()}
    assert got == {k: min(g) for g in groups for k in g if k in got}


def test_clusters_in_rounds_are_those_of_one_task(spark):
    """Dense groups with loose links between them, in one component; equal pairs; loops, repeats and null ends."""
    rng = np.random.default_rng(8)
    n = 60
    i, j = np.triu_indices(n, 1)
    score = np.where(i // 20 == j // 20, rng.uniform(0.7, 1.0, len(i)), rng.uniform(0.2, 0.85, len(i)))
    rows = [*zip(i.tolist(), j.tolist(), score.tolist(), strict=True), (3, 3, 1.0), (None, 4, 1.0), (2000, 2001, 0.5)]
    rows += [(1000 + a, 1000 + b, 1.0) for a in range(16) for b in range(a)]
    df = spark.createDataFrame(rows, "a long, b long, score double")
    whole, rounds = ({r["node"]: r["cluster"] for r in resolve.clusters(df, in_task=k).collect()} for k in (2000, 30))
    assert whole == rounds and {whole[1000 + k] for k in range(16)} == {1000} and 2000 not in whole
    assert resolve.clusters(spark.createDataFrame([], "a long, b long, score double")).count() == 0


def _edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def test_fuzzy_names_miss_no_pair(spark):
    rng = random.Random(1)
    names = {"photosynthesis", "fhotosynthesia", "gear", "gears", "a", "ab", "abcde", "abcdf", "xbcde"}
    for _ in range(60):
        base = [rng.choice("abc") for _ in range(rng.randint(1, 16))]
        for _ in range(4):
            copy = list(base)
            for _ in range(rng.randint(0, 3)):
                at = rng.randrange(len(copy) + 1)
                copy[at : at + rng.randint(0, 1)] = [rng.choice("abc")] * rng.randint(0, 1)
            names.add("".join(copy))
    names = sorted(names - {""})
    want = {(a, b) for a in names for b in names if a < b and 5 * _edits(a, b) <= max(len(a), len(b))}
    df = spark.createDataFrame([(x,) for x in [*names, ""]], "name string")
    got = {(r["a"], r["b"]) for r in text.fuzzy_names(df, df).collect()}
    assert got == want and ("fhotosynthesia", "photosynthesis") in got


def test_sections_of_a_deep_tree(spark):
    rows = [(1, k, k - 1 if k > 1 else None, f"t{k}") for k in range(1, 9)] + [(2, 5, 4, "lost")]
    got = text.tree_sections(spark.createDataFrame(rows, "doc_id long, node long, parent long, title string")).orderBy("pos").collect()
    assert [r["node"] for r in got] == list(range(1, 9)) and got[-1]["path"].count(" > ") == 7


def test_beam_search_stops_at_unmet_prerequisites(spark):
    concepts = spark.createDataFrame([(k, 60, 1) for k in range(1, 6)], "concept_id long, time_estimate int, difficulty int")
    edges = spark.createDataFrame([(1, 2, "NEXT"), (1, 3, "NEXT"), (2, 5, "REQUIRES"), (3, 1, "REQUIRES"), (3, 4, "NEXT")], "source long, target long, rel_type string")
    mastery = spark.createDataFrame([(7, 1, 0.9), (7, 4, 0.5)], "learner_id long, concept_id long, level double")
    starts = spark.createDataFrame([(7, 1)], "learner_id long, concept_id long")
    got = {r["path"]: r["score"] for r in planning.beam_search(starts, edges, mastery, concepts).collect()}
    # 2 needs 5, which is not mastered; 3 needs 1, which is; 2 has no way on
    assert got == {"1>3>4": round(0.4 * (0.9 + 0.5) / 3 + 0.4, 6), "1>2": 0.0}
