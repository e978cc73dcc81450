"""Joins whose result has all pairs of a group are dealt to many tasks and meet no more rows than they return, or nearly."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import functions as F

from scholarflow.operators import resolve
from scholarflow.store import new_folder
from scholarflow.streaming import jobs


def test_pairs_of_a_group_of_many_parts(spark):
    rows = [(k, "n", "b", k % 3 if k % 7 else None) for k in range(50)] + [(100, "n", "c", 1), (101, "m", "b", 1), (102, "m", "b", 1), (103, None, "b", 1), (104, None, "b", 1)]
    concepts = spark.createDataFrame(rows, "concept_id long, name string, brand string, difficulty int")
    expected = {(a[0], b[0]): 1.0 if a[3] is not None and a[3] == b[3] else 0.7 for a, b in combinations(rows, 2) if a[1] and a[1:3] == b[1:3]}
    for block in (4, 1024):
        found = resolve.pairs_within(concepts, block).collect()
        assert len(found) == len(expected)
        assert {(r["a"], r["b"]): r["score"] for r in found} == expected


def test_context_join_is_keyed_by_time_too(spark):
    at = lambda k: F.timestamp_seconds(1_700_000_000 + k * 1800 + F.when(k % 5 == 0, 0).otherwise(k))
    rows = spark.range(400).select("id", (F.col("id") % 2).cast("int").alias("concept_id"), at(F.col("id")).alias("ts"))
    where = new_folder(spark, "context-join")
    rows.coalesce(1).write.parquet(where)
    stream = spark.readStream.schema(rows.schema).parquet(where)
    sel = stream.filter("id % 4 < 2").select("concept_id", "ts", F.col("id").alias("context"))
    fb = stream.filter("id % 4 >= 2").select("concept_id", "ts", F.col("id").alias("feedback_id"))
    spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    out = new_folder(spark, "context-join")
    query = jobs.context_join(sel, fb).writeStream.option("checkpointLocation", f"{out}/c").trigger(availableNow=True).format("parquet").start(f"{out}/out")
    query.awaitTermination()
    all_ = [tuple(r) for r in rows.select("id", "concept_id", F.unix_seconds("ts")).collect()]
    expected = sorted((f[0], s[0]) for f in all_ if f[0] % 4 >= 2 for s in all_ if s[0] % 4 < 2 and s[1] == f[1] and f[2] - 86400 <= s[2] <= f[2])
    assert sorted(tuple(r) for r in spark.read.parquet(f"{out}/out").collect()) == expected
    # every selection is in the state of five spans of six hours
    kept = max(sum(p["numRowsTotal"] for p in x["stateOperators"]) for x in query.recentProgress)
    assert kept == 5 * 200 + 200
