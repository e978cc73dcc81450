"""What several operators of this subpackage share: reading, folds, checkpoints, bucket splitting, components."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator
from contextlib import contextmanager, suppress

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import store
from ..operators.components import components  # noqa: F401

#: Characters or bytes of a batch that are worked on at a time.
SLICE = 2_000_000
#: Bytes of an Arrow batch.
BATCH_BYTES = 8 << 20
#: Bits of the filters that keep rows out of joins in which they have no part: 2 MB.
FILTER_BITS = 1 << 24
#: ASCII white space, the only separators of words here.
SPACE = r"\x20\x09-\x0D"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def held_out(doc_id: Column) -> Column:
    """True for the third of the rows that no model may learn from; a null id is never held out."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 == 1, F.lit(False))


def release_memory() -> None:
    """Gives memory that a task no longer needs back to the system: Python workers are kept for later tasks."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with suppress(AttributeError, OSError):  # where there is no GNU library
        ctypes.CDLL(None).malloc_trim(0)


@contextmanager
def _setting(spark: SparkSession, key: str, value: str) -> Iterator[None]:
    """While it lasts, a setting of the session has another value; its own comes back."""
    before = spark.conf.get(key, None)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, before)


def _small_batches(spark: SparkSession):
    """While it lasts, an Arrow batch holds `BATCH_BYTES` at most: texts can be long."""
    return _setting(spark, "spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def checkpointed(df: DataFrame) -> DataFrame:
    """`store.checkpointed` with small Arrow batches."""
    with _small_batches(df.sparkSession):
        return store.checkpointed(df)


def dealt(df: DataFrame, column: str) -> DataFrame:
    """`df`, checkpointed and dealt by a column into the session's number of partitions: later joins on the column leave its rows where they lie.

    A checkpoint that is taken under adaptive execution forgets how its rows were dealt, so this one is taken without.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    with _setting(df.sparkSession, "spark.sql.adaptive.enabled", "false"):
        return checkpointed(df.repartition(parts, column))


def written(df: DataFrame) -> DataFrame:
    """`store.written` with small Arrow batches."""
    with _small_batches(df.sparkSession):
        return store.written(df)


def packed(df: DataFrame, *columns: str | Column) -> DataFrame:
    """`columns` of `df`, and each whole row as a struct `row`: what is added beside them can clash with no column."""
    return df.select(*columns, F.struct("*").alias("row"))


def unpacked(df: DataFrame, columns: list[str], **changed: Column) -> DataFrame:
    """The rows of `packed`, with some columns changed; each other value comes back as it was."""
    return df.select(*[changed[c].alias(c) if c in changed else F.col("row").getField(c).alias(c) for c in columns])


def flagged(df: DataFrame, key: str, keys: DataFrame, flag: str = "maybe", bits: int = FILTER_BITS) -> DataFrame:
    """`df` with a boolean `flag`: false only where the long `key` is in no row of the one column of `keys`.

    A Bloom filter of one hash: the keys set bits in at most `bits` / 64 words, which is the bound of what is
    broadcast, whatever the number of keys. The more keys, the more other rows pass; a full filter passes all.
    """
    place = lambda k: F.pmod(k, F.lit(bits))
    k = keys.select(place(F.col(keys.columns[0])).alias("k"))
    words = k.groupBy(F.shiftright("k", 6).alias("_word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(k & 63 as int))")).alias("_bits"))
    of = df.withColumn("_place", place(F.col(key))).withColumn("_word", F.shiftright("_place", 6)).join(F.broadcast(words), "_word", "left")
    hit = F.coalesce(F.expr("shiftright(_bits, cast(_place & 63 as int)) & 1 = 1"), F.lit(False))
    return of.withColumn(flag, hit).drop("_word", "_place", "_bits")


def with_columns_from(
    df: DataFrame, column: str, fields: T.StructType, make: Callable[[], Callable[[list], list[tuple]]]
) -> DataFrame:
    """`df` with a struct column `_out` of `fields`, made from one column by an Arrow-batched function.

    `make()` runs once per task and returns a function that takes the values of a batch (None for null)
    and gives a tuple for each. The other columns never leave the JVM. A column `_out` of `df` is replaced.
    """

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        each, values, held = make(), None, None

        def done(rows: list) -> pd.DataFrame:
            return pd.DataFrame(dict(zip(fields.names, zip(*each(rows), strict=True), strict=True)) if rows else {}, columns=fields.names)

        for values in batches:
            held, size = [], 0
            for v in values:
                held.append(v)
                size += 0 if v is None else len(v)
                if size > SLICE:
                    yield done(held)
                    held, size = [], 0
            yield done(held)
        del each, values, held
        release_memory()

    # the hints are read when the function is registered
    run.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.DataFrame]}
    # else a filter on the result would run the function twice, in two more workers
    once = F.pandas_udf(run, fields).asNondeterministic()
    return df.withColumn("_out", once(F.col(column)))


def block_pairs(df: DataFrame, key: str, order: Column, limit: int, weight: Column | int = 1) -> DataFrame:
    """Deals the rows of each bucket `key` to tasks of at most about 2 x `limit` rows, or as much `weight` of rows.

    A bucket of n rows is cut into b = ceil(n / limit) blocks by `order` (a hash column), and every
    pair of blocks (i <= j) becomes one task, so that any two rows of the bucket meet in exactly one
    task with i < j or, for rows of one block, in the task i = j. Buckets of one row are dropped.
    Adds block_i, block_j and own (this row's block).
    """
    sizes = df.groupBy(key).agg(F.count(F.lit(1)).alias("_n"), F.sum(F.lit(weight) if isinstance(weight, int) else weight).alias("_w")).filter("_n > 1")
    blocks = df.join(sizes, key).withColumn("_b", F.ceil(F.col("_w") / limit).cast("int"))
    blocks = blocks.withColumn("own", F.when(F.col("_b") == 1, 0).otherwise(F.pmod(order, F.col("_b"))).cast("int"))
    return (
        blocks.withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_b") - 1)))
        .withColumn("block_i", F.least("own", "_other"))
        .withColumn("block_j", F.greatest("own", "_other"))
        .drop("_n", "_w", "_b", "_other")
    )
