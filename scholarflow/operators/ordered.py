"""Ordered work on keys of any size: sums, carried values and folds over ranges of the order.

Rows are sorted by range over (key, order), so that the rows of one key may lie in many tasks. Each range
gives one summary for each key that it holds; the summaries of a key, at most one for each range, are put in order,
and each range takes what came before it. No task and no row ever holds the whole history of a key.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..store import checkpointed

#: Bits of a row's number within its range, as `monotonically_increasing_id` counts.
ROW_BITS = 33
#: Bits of the number of elements that one row of a fold holds at most.
CHUNK_BITS = 10


def ranged(rows: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """`rows`, checkpointed, with `at`, their number in the order of (keys, order), and `range`, the task that had them.

    Numbers grow along the order, and by one from row to row within a range. Ties of `order` come in any order: give enough columns.
    """
    by = [*keys, *order]
    rows = checkpointed(rows.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("at", F.monotonically_increasing_id()))
    return rows.withColumn("range", F.shiftright("at", ROW_BITS))


def _with_before(rows: DataFrame, keys: Sequence[str], summary: Column, before: Callable[[Column], Column]) -> DataFrame:
    """`rows` with `_before`: what `before` makes, over the earlier ranges of the key, of each range's `summary`."""
    parts = rows.groupBy(*keys, "range").agg(summary.alias("_part"))
    earlier = Window.partitionBy(*keys).orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select(F.col("range").alias("_range"), *[F.col(k).alias(f"_key_{k}") for k in keys], before(F.col("_part")).over(earlier).alias("_before"))
    same = F.col("range") == F.col("_range")
    for k in keys:
        same &= F.col(k).eqNullSafe(F.col(f"_key_{k}"))
    return rows.join(parts, same, "left").select(*rows.columns, "_before")


def running_sum(rows: DataFrame, keys: Sequence[str], order: Sequence[str], amount: str, name: str = "before") -> DataFrame:
    """`rows` with the sum of `amount` over the earlier rows of the key in a column `name`, 0 for the first."""
    rows = _with_before(ranged(rows, keys, order), keys, F.sum(amount), F.sum)
    within = Window.partitionBy("range", *keys).orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    total = F.coalesce(F.sum(amount).over(within), F.lit(0)) + F.coalesce("_before", F.lit(0))
    return rows.withColumn(name, total).drop("at", "range", "_before")


def carried_last(rows: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, name: str = "last") -> DataFrame:
    """`rows` with the last `value` that is not null, of this row or an earlier one of the key, in a column `name`."""
    rows = _with_before(ranged(rows, keys, order), keys, F.max_by(value, F.when(F.col(value).isNotNull(), F.col("at"))), lambda c: F.last(c, ignorenulls=True))
    within = Window.partitionBy("range", *keys).orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn(name, F.coalesce(F.last(value, ignorenulls=True).over(within), "_before")).drop("at", "range", "_before")


def fold(rows: DataFrame, keys: Sequence[str], order: Sequence[str], step: Column, compose: Callable[[Column, Column], Column]) -> DataFrame:
    """keys, `n` (rows) and `composed`: the steps of each key in their order, composed into one.

    `step` is a row's step (a struct or an array) and `compose(f, g)` the step that does what f and then g do: an associative
    function whose result has the type of a step. Runs of 2 ** `CHUNK_BITS` neighbours are composed at a time, level by level, until a key has one.
    """
    found = ranged(rows.select(*keys, *order, step.alias("_step")), keys, order).select(*keys, F.col("at").alias("_at"), F.lit(1).cast("long").alias("n"), "_step")
    whole = lambda a: F.aggregate(F.slice(a, 2, F.greatest(F.size(a) - 1, F.lit(0))), a[0]["_step"], lambda s, x: compose(s, x["_step"]))
    bits = CHUNK_BITS
    while True:
        found = found.withColumn("_order", F.col("_at")).withColumn("_at", F.shiftright("_at", bits))
        parts = found.groupBy(*keys, "_at").agg(F.sum("n").alias("n"), F.array_sort(F.collect_list(F.struct("_order", "_step"))).alias("a"))
        found = checkpointed(parts.select(*keys, "_at", "n", whole(F.col("a")).alias("_step")))
        most = found.groupBy(*keys).agg(F.count(F.lit(1)).alias("k")).agg(F.max("k")).first()[0] or 1
        if most == 1:
            return found.select(*keys, "n", F.col("_step").alias("composed"))
        bits = CHUNK_BITS if most > 1 << CHUNK_BITS else 63  # the rest of a key at once, if it is few enough
