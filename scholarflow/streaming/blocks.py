"""An interval join over blocks of rows, so that neither the state nor the written result of a stream holds every pair by itself."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows of a block at most, and rows that a task packs at a time, about.
BLOCK, HELD = 2048, 1 << 20
#: Tasks of `pairs` for each core.
TASKS = 4


def _held(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """`batches` joined into tables of about `HELD` rows."""
    held, n = [], 0
    for batch in batches:
        held.append(batch)
        n += batch.num_rows
        if n >= HELD:
            yield pa.Table.from_batches(held)
            held, n = [], 0
    if n:
        yield pa.Table.from_batches(held)


def packed(rows: DataFrame, key: str, value: str, span: int) -> DataFrame:
    """Rows (`key`, ts, `value`) as blocks: the rows of a key and `span` seconds that a batch brings, in order of time, `BLOCK` at most.

    A block's ts is the start of its span, its value the times (microseconds) and values of its rows. Rows without key or time, which no interval holds, are left out.
    """
    width = F.lit(span * 1_000_000)
    kept = rows.filter(F.col(key).isNotNull() & F.col("ts").isNotNull()).select(key, F.unix_micros("ts").alias("at"), value)
    kept = kept.withColumn("start", F.col("at") - F.pmod("at", width)).repartition(key, "start")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _held(batches):
            table = table.sort_by([(c, "ascending") for c in (key, "start", "at")])
            keys, start, at, values = (table[c].combine_chunks() for c in (key, "start", "at", value))
            new = np.ones(len(start), bool)
            new[1:] = np.diff(start.to_numpy()) != 0
            new[1:] |= pc.not_equal(keys[1:], keys[:-1]).to_numpy(zero_copy_only=False)
            place = np.arange(len(new))
            cuts = np.flatnonzero((place - np.maximum.accumulate(np.where(new, place, 0))) % BLOCK == 0)
            ends = pa.array(np.append(cuts, len(new)), pa.int32())
            lists = [pa.ListArray.from_arrays(ends, x) for x in (at, values)]
            yield pa.RecordBatch.from_arrays([keys.take(pa.array(cuts)), start.take(pa.array(cuts)), pa.StructArray.from_arrays(lists, ["at", "rows"])], [key, "start", value])

    kinds = {c: rows.schema[c].dataType.simpleString() for c in (key, value)}
    blocks = kept.mapInArrow(pack, f"`{key}` {kinds[key]}, start long, `{value}` struct<at: array<long>, rows: array<{kinds[value]}>>")
    return blocks.select(key, F.timestamp_micros("start").alias("ts"), value)


def matched(blocks: DataFrame, left: str, right: str, reach: int) -> DataFrame:
    """Of joined blocks, each left row with the run of right rows in the `reach` seconds up to its time: the run's first place, from 1, and its length."""

    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            (l_at, l_rows), (r_at, r_rows) = (batch.column(c).flatten() for c in (left, right))
            first, length, held = [], [], []
            for a, b in zip(l_at, r_at, strict=True):
                a, b = a.values.to_numpy(), b.values.to_numpy()
                low = np.searchsorted(b, a - reach * 1_000_000, "left")
                n = np.searchsorted(b, a, "right") - low
                first.append(low + 1)
                length.append(n)
                held.append(np.count_nonzero(n))
            if not any(held):
                continue
            first, length, held = np.concatenate(first), np.concatenate(length), np.array(held)
            met = length > 0
            runs = pa.StructArray.from_arrays([l_rows.flatten().filter(pa.array(met)), pa.array(first[met], pa.int32()), pa.array(length[met], pa.int32())], ["row", "first", "n"])
            runs = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(held)), pa.int32()), runs)
            some = pa.array(held > 0)
            yield pa.RecordBatch.from_arrays([runs.filter(some), r_rows.filter(some)], [left, right])

    kinds = {c: blocks.schema[c].dataType["rows"].dataType.elementType.simpleString() for c in (left, right)}
    return blocks.select(left, right).mapInArrow(match, f"`{left}` array<struct<row: {kinds[left]}, first: int, n: int>>, `{right}` array<{kinds[right]}>")


def pairs(runs: DataFrame, left: str, right: str) -> DataFrame:
    """Every pair of the runs that `matched` found, one row each."""
    runs = runs.repartition(TASKS * runs.sparkSession.sparkContext.defaultParallelism)
    each = runs.select(F.explode(left).alias("_l"), right).select(F.col("_l.row").alias(left), F.slice(right, F.col("_l.first"), F.col("_l.n")).alias(right))
    # the coalesce joins no partitions: it keeps the two explodes in two pipelines, so that a task holds the pairs of one left row at a time, not of a block.
    # No run is empty; the outer form only saves the check for that, which would cut every run out twice.
    return each.coalesce(1 << 20).select(left, F.explode_outer(right).alias(right))
