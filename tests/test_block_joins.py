"""The interval join over blocks: what the stream writes and keeps grows with its rows, the result has every pair."""

from __future__ import annotations

import duckdb
import pytest
from pyspark.sql import functions as F

from scholarflow.plans.catalog import ORACLE_SQL, QUERIES
from scholarflow.store import new_folder
from scholarflow.streaming import blocks, jobs

AT = 1_700_006_400  # a multiple of six hours


def _events(folder, rows: str):
    con = duckdb.connect()
    con.execute(f"copy (select * from ({rows})) to '{folder}/events.parquet' (format parquet)")
    con.execute(f"create view events as select * from '{folder}/events.parquet'")
    return con


@pytest.mark.parametrize("n", [0, 1, 9000])
def test_hot_concept_is_written_as_runs(spark, tmp_path, n):
    # one concept, 6 000 events in five hours of a day and 3 000 on the next: two blocks in a span, equal times, matches at exactly 24 hours
    rows = f"""select i as event_id, timestamp '2024-03-01 00:00:00' + to_seconds(i // 4 * 12 + case when i < 6000 then 0 else 68400 end) as ts, i % 11 as user_id, 'view' as event_type,
      case when i % 97 <> 5 then (i * 37 % 1000) / 4.0 end as value, '{{"k": ' || (case when i % 501 = 4 then 8 else 3 end) || '}}' as props from range({n}) t(i)"""
    con = _events(tmp_path, rows)
    df = QUERIES["stm_context_join"](spark, str(tmp_path))
    each = "select feedback_id, count(*) as n, cast(sum(round(context * 1000000)) as bigint) as total, cast(max(round(context * 1000000)) as bigint) as most from q group by 1"
    df.createOrReplaceTempView("q")
    expected = con.execute(each.replace(" from q", f" from ({ORACLE_SQL['stm_context_join']}) q")).fetchall()
    assert sorted(tuple(r) for r in spark.sql(each).collect()) == sorted(expected)
    assert sum(r[1] for r in expected) > 8_000_000 or n < 9000
    # the files hold a run for each feedback and block that it meets, not its pairs
    written = spark.read.parquet(*df.inputFiles()) if n == 9000 else None
    assert written is None or written.count() < 500 and written.agg(F.sum(F.size("feedback_id"))).first()[0] < 100_000


def _joined(spark, batches, context="double"):
    where, out = new_folder(spark, "blocks"), new_folder(spark, "blocks")
    schema = f"id long, side string, concept_id int, at double, context {context}"
    for batch in batches:
        rows = spark.createDataFrame(batch, schema).select("id", "side", "concept_id", F.timestamp_seconds("at").alias("ts"), "context")
        rows.coalesce(1).write.mode("append").parquet(where)
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(where)
    sel, fb = stream.filter("side = 's'").select("concept_id", "ts", "context"), stream.filter("side = 'f'").select("concept_id", "ts", F.col("id").alias("feedback_id"))
    found = blocks.pairs(jobs.replay(fb, lambda s: jobs.context_runs(sel, s), out), "feedback_id", "context")
    return sorted((tuple(r) for r in found.collect()), key=str)


def test_late_rows_within_the_delay_still_meet(spark):
    # 9.5 minutes behind the newest row of the batch before, and in the span before its span
    first = [(1, "s", 1, AT + 240.0, 0.1), (2, "f", 1, AT + 240.0, None)]
    then = [(3, "s", 1, AT - 330.0, 0.2), (4, "f", 1, AT - 300.0, None), (5, "f", 1, AT + 3600.0, None)]
    assert _joined(spark, [first, then]) == [(2, 0.1), (2, 0.2), (4, 0.2), (5, 0.1), (5, 0.2)]


def test_edges_nulls_and_other_types(spark):
    day = 86400.0
    rows = [(1, "s", 1, AT - 0.000001, "a"), (2, "s", 1, AT + 0.0, None), (3, "s", 1, AT + 0.0, "b"), (4, "s", 2, AT + 0.0, "c"), (5, "s", None, AT + 0.0, "d"), (6, "s", 1, None, "e"),
            (7, "f", 1, AT + day, None), (8, "f", 1, AT + day - 0.000001, None), (9, "f", 1, AT + 0.0, None), (10, "f", 1, AT - 0.000002, None), (11, "f", None, AT + 1.0, None), (12, "f", 1, None, None)]
    met = [(7, "b"), (7, None), (8, "a"), (8, "b"), (8, None), (9, "a"), (9, "b"), (9, None)]
    assert _joined(spark, [rows], "string") == sorted(met, key=str)
