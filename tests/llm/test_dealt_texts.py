"""Texts that near copies need are dealt once, and joins on their class leave them there; centres are compared by bit planes."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from scholarflow.llm import near_copies


@pytest.mark.parametrize("own", [True, False], ids=["class of the text", "hash beside it"])
def test_joins_on_the_class_leave_texts_where_they_lie(spark, own):
    docs = spark.range(400).select(F.concat(F.lit("text "), F.col("id") % 100).alias("text"))
    hashes = docs.select(F.xxhash64("text").alias("hash")).distinct()
    active = hashes.withColumnRenamed("hash", "cls") if own else hashes.withColumn("cls", F.col("hash") + 1)
    active = spark.createDataFrame(active.collect(), active.schema)
    adaptive = spark.conf.get("spark.sql.adaptive.enabled")
    texts = near_copies._texts(active, docs)
    assert spark.conf.get("spark.sql.adaptive.enabled") == adaptive
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        met = texts.join(active.select("cls"), "cls")
        plan = met._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange hashpartitioning") == 1, plan
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    want = {t for (t,) in docs.distinct().collect()}
    assert {r["text"] for r in met.collect()} == want and texts.count() == 100


def test_centres_are_compared_by_bit_planes():
    bits = np.random.default_rng(2).integers(-(1 << 63), 1 << 63, 1001, np.int64)
    bits[:3] = 0, (1 << near_copies.RADIUS) - 1, (1 << near_copies.RADIUS + 1) - 1
    rows = pd.DataFrame({"cls": np.arange(1001), "bits": bits})
    got = pd.concat(near_copies._near_centres(iter([rows[:1000], rows[:0], rows[1000:]])))
    want = [k for k, x in enumerate(bits.tolist()) if (x & (1 << 64) - 1).bit_count() <= near_copies.RADIUS]
    assert sorted(got["cls"]) == want and 2 not in want and len(want) > 50
