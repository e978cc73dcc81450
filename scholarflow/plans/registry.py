"""Registered queries: a DataFrame plan over the views, and SQL for DuckDB where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .views import Views, oracle

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
#: Added before cutting to 6 digits: a little over a half, so that exact halves, which engines round either way, go up.
_HALF = 0.500001


def add(name: str, plan: Callable[[Views], DataFrame], sql: str | None = None, floats: str = "", times: str = "") -> None:
    """Registers `plan`; columns named in `floats` are rounded to 6 digits on both sides, `times` become seconds."""
    rounded, seconds = floats.split(), times.split()

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = plan(Views(spark, sf_dir))
        return df.withColumns({c: F.floor(F.col(c).cast("double") * 1_000_000 + _HALF) / 1_000_000 for c in rounded} | {c: F.unix_timestamp(c) for c in seconds})

    run.__name__ = name
    QUERIES[name] = run
    if sql:
        changed = [f"floor(cast({c} as double) * 1000000 + {_HALF}) / 1000000 as {c}" for c in rounded] + [f"cast(floor(epoch({c})) as bigint) as {c}" for c in seconds]
        text = oracle(sql)
        ORACLE_SQL[name] = f"select * replace ({', '.join(changed)}) from ({text}) q" if changed else text
