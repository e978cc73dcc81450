"""Every registered query with SQL against DuckDB on the same files; the others keep what they promise."""

from __future__ import annotations

import math

import duckdb
import numpy as np
import pytest

from scholarflow.operators import planning
from scholarflow.plans.catalog import ORACLE_SQL, QUERIES
from scholarflow.plans.views import TABLES


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return con


def _norm(x):
    if hasattr(x, "item"):
        x = x.item()
    if x is None or (isinstance(x, float) and math.isnan(x)):
        return "null"
    return f"{x + 0.0:.6f}" if isinstance(x, float) else str(x)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_matches_sql(spark, sf_dir, duck, name):
    df = QUERIES[name](spark, sf_dir)
    columns = sorted(df.columns)
    got = sorted(tuple(_norm(r[c]) for c in columns) for r in df.collect())
    found = duck.execute(ORACLE_SQL[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == columns
    at = [names.index(c) for c in columns]
    assert got == sorted(tuple(_norm(r[k]) for k in at) for r in found.fetchall())


def test_streams_equal_their_batch_twins(spark, sf_dir):
    batch = {(r["learner_id"], r["concept_id"]): (round(r["mastery"], 9), r["attempts"]) for r in QUERIES["win_ewma_mastery"](spark, sf_dir).collect()}
    stream = {(r["learner_id"], r["concept_id"]): (round(r["mastery"], 5), r["attempts"]) for r in QUERIES["stm_mastery"](spark, sf_dir).collect()}
    assert stream.keys() == batch.keys()
    assert all(abs(stream[k][0] - batch[k][0]) < 1e-4 and stream[k][1] == batch[k][1] for k in batch)


def test_clusters_are_within_components(spark, sf_dir):
    pairs = {(r["a"], r["b"]) for r in QUERIES["join_pairs_within"](spark, sf_dir).filter("score >= 0.8").collect()}
    of = {r["node"]: r["cluster"] for r in QUERIES["grf_cluster"](spark, sf_dir).collect()}
    assert all(a in of and b in of for a, b in pairs) and all(c <= n for n, c in of.items())


def test_paths_stay_in_budget(spark, sf_dir):
    rows = QUERIES["grf_greedy_path"](spark, sf_dir).collect()
    assert rows and all(r["hours_before"] < 16 for r in rows)


def test_bootstrap_interval_is_ordered(spark, sf_dir):
    r = QUERIES["exp_bootstrap_ci"](spark, sf_dir).first()
    assert r["low"] <= r["median"] <= r["high"]


def test_linucb_matches_numpy(spark):
    rng = np.random.default_rng(2)
    arms, rows = {}, []
    for concept in (3, 5, 8, 13):
        x, r = rng.uniform(0, 1, (6, 3)), rng.uniform(0, 1, 6)
        arms[concept] = np.eye(3) + x.T @ x, x.T @ r
        rows += [(concept, i, j, float(arms[concept][0][i, j])) for i in range(3) for j in range(3)] + [(concept, i, -1, float(arms[concept][1][i])) for i in range(3)]
    learners = [(k, rng.uniform(0, 1, 3).tolist()) for k in range(40)]
    got = planning.linucb_select(spark.createDataFrame(rows, "concept_id long, row int, col int, v double"), spark.createDataFrame(learners, "learner_id long, x array<double>"), 3).collect()
    assert len(got) == 40
    for r in got:
        x = np.array(learners[r["learner_id"]][1])
        bound = {c: x @ np.linalg.solve(a, b) + np.sqrt(x @ np.linalg.solve(a, x)) for c, (a, b) in arms.items()}
        assert r["concept_id"] == max(bound, key=bound.get) and abs(r["bound"] - max(bound.values())) < 1e-5


def test_cycle_edges_have_ways_in_and_out(spark, sf_dir):
    rows = QUERIES["grf_cycle_check"](spark, sf_dir).collect()
    assert {r["source"] for r in rows} == {r["target"] for r in rows}
