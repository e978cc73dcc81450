"""Few rows are not dealt to as many files as the session has shuffle partitions."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from scholarflow import store
from scholarflow.operators import components as C

MANY = 16


@pytest.fixture
def many(spark):
    before = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    spark.conf.set("spark.sql.shuffle.partitions", str(MANY))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield spark
    for k, v in before.items():
        spark.conf.set(k, v)


def test_few_edges_stay_in_few_tasks(many):
    out = C.components(many.range(300).select(F.col("id").alias("a"), (F.col("id") + 3).alias("b")))
    assert out.rdd.getNumPartitions() < MANY // 4
    assert {(r["node"], r["component"]) for r in out.collect()} == {(k, k % 3) for k in range(303)}


def test_many_edges_are_dealt_out(many, monkeypatch):
    monkeypatch.setattr(C, "EDGES", 10)
    out = C.components(many.range(300).select(F.col("id").alias("a"), (F.col("id") + 3).alias("b")))
    assert out.rdd.getNumPartitions() >= MANY
    assert {(r["node"], r["component"]) for r in out.collect()} == {(k, k % 3) for k in range(303)}


def test_compacted_joins_partitions_up_to_a_size(many, monkeypatch):
    rows = store.checkpointed(many.range(1000).repartition(MANY))
    assert store.compacted(rows, 16).rdd.getNumPartitions() == 1
    assert store.compacted(rows.filter("id < 0"), F.col("id")).count() == 0
    monkeypatch.setattr(store, "PART", 4000)
    monkeypatch.setattr(store, "TINY", 1001)
    assert store.compacted(rows, 16).rdd.getNumPartitions() == 4
    assert store.compacted(rows, F.lit(16)).rdd.getNumPartitions() == 4
    assert store.compacted(rows, 17).rdd.getNumPartitions() == MANY
