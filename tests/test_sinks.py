"""The merging sink: once for each batch, retries, and rows put aside."""

from __future__ import annotations

from pyspark.sql import functions as F

from scholarflow.store import new_folder
from scholarflow.streaming.sinks import MergeSink


def rows_of(sink, spark):
    return {k: sorted((r["id"], r["v"], r["tried"]) for r in df.collect()) for k, df in sink.tables(spark).items()}


def test_batches_count_once_and_failing_rows_are_retried(spark):
    allowed = {"a", "b"}
    sink = MergeSink(new_folder(spark, "sink"), ["id"], lambda rows: F.col("v").isin(*allowed))
    batch = lambda *rows: spark.createDataFrame(list(rows), "id long, v string")
    sink(batch((1, "a"), (2, "x"), (3, "y"), (4, None)), 0)
    first = rows_of(sink, spark)
    assert first == {"merged": [(1, "a", 1)], "retry": [(2, "x", 1), (3, "y", 1), (4, None, 1)], "aside": []} or first["retry"][:2] == [(2, "x", 1), (3, "y", 1)]
    sink(batch((9, "b")), 0)  # run again, even with other rows
    assert rows_of(sink, spark) == first
    # what is missing comes later, and a newer row takes the place of one that waits
    allowed.add("x")
    sink(batch((3, "b"), (1, "b")), 1)
    assert rows_of(sink, spark)["merged"] == [(1, "b", 1), (2, "x", 2), (3, "b", 1)]
    sink.drained(spark)
    last = rows_of(sink, spark)
    assert last["aside"] == [(4, None, 3)] and last["retry"] == []


def test_a_batch_that_broke_off_leaves_nothing(spark):
    sink = MergeSink(new_folder(spark, "sink"), ["id"], lambda rows: F.col("v") == "a")
    sink(spark.createDataFrame([(1, "a"), (2, "z")], "id long, v string"), 0)
    before = rows_of(sink, spark)
    # a batch that wrote its rows but never reached the ledger
    spark.createDataFrame([(5, 1, "a", 1)], "id long, first_batch int, v string, tried int").write.parquet(f"{sink.where}/merged/batch=1")
    assert rows_of(sink, spark) == before
    sink(spark.createDataFrame([(6, "a")], "id long, v string"), 1)
    assert rows_of(sink, spark) == {"merged": [(1, "a", 1), (6, "a", 1)], "retry": [(2, "z", 2)], "aside": []}
