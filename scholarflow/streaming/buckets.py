"""Keys dealt to buckets, so that a stateful job calls Python once a bucket and batch instead of once a key."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, GroupedData
from pyspark.sql import functions as F

#: How many; a bucket's state is about this part of the state of all keys. A checkpoint is bound to it.
BUCKETS = 1024


def bucketed(rows: DataFrame, key: str) -> GroupedData:
    """`rows` grouped by the bucket of their `key`, the same in every batch; a key is in one bucket only."""
    return rows.withColumn("_bucket", F.pmod(F.xxhash64(key), F.lit(BUCKETS))).groupBy("_bucket")


def ordered(batches: Iterator[pd.DataFrame], *by: str) -> pd.DataFrame:
    """A bucket's rows of one batch in the order of `by`."""
    parts = list(batches)
    return pd.concat(parts).sort_values(list(by)) if parts else pd.DataFrame()
