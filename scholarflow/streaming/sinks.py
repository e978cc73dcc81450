"""A sink that merges each batch exactly once, retries the rows that fail, and puts them aside after some tries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


class MergeSink:
    """For `foreachBatch`: merges rows into a table under `where`, the newest batch's row of each key counting.

    Each batch writes, in folders with its number that a second run of it replaces, the rows that `accept`s let through, the rows to be
    tried again with the next batch, and those that have failed `tries` times; last it enters its number in the ledger. Only batches of
    the ledger are read, and a batch that is in it does nothing, so neither a batch that is run again nor one that broke
    off half way changes the tables. A row that fails keeps its place: a newer row of its key replaces it.
    """

    KINDS = ("merged", "retry", "aside")

    def __init__(self, where: str, keys: list[str], accept: Callable[[DataFrame], Column], tries: int = 3):
        self.where, self.keys, self.accept, self.tries = where, keys, accept, tries

    def _read(self, spark: SparkSession, kind: str) -> DataFrame | None:
        try:
            return spark.read.parquet(f"{self.where}/{kind}")
        except AnalysisException as e:
            if e.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
                return None
            raise

    def _batches(self, spark: SparkSession) -> list[int]:
        ledger = self._read(spark, "ledger")
        # one number a batch
        return sorted(r["batch"] for r in ledger.select("batch").collect()) if ledger is not None else []

    def __call__(self, batch: DataFrame, n: int) -> None:
        spark = batch.sparkSession
        done = self._batches(spark)
        if n in done:
            return
        rows = batch.withColumn("tried", F.lit(0)).withColumn("first_batch", F.lit(n))
        if done:
            waiting = self._read(spark, "retry").filter(F.col("batch") == max(done)).drop("batch")
            rows = rows.unionByName(waiting.join(batch.select(*self.keys).distinct(), self.keys, "left_anti"))
        newest = F.struct("first_batch", *[c for c in rows.columns if c not in (*self.keys, "first_batch")])
        rows = rows.groupBy(*self.keys).agg(F.max(newest).alias("x")).select(*self.keys, "x.*")
        rows = rows.withColumn("ok", F.coalesce(self.accept(rows), F.lit(False))).withColumn("tried", F.col("tried") + 1)
        kinds = {"merged": F.col("ok"), "retry": ~F.col("ok") & (F.col("tried") < self.tries), "aside": ~F.col("ok") & (F.col("tried") >= self.tries)}
        for kind, which in kinds.items():
            rows.filter(which).drop("ok").write.mode("overwrite").parquet(f"{self.where}/{kind}/batch={n}")
        spark.createDataFrame([(n,)], "n long").write.mode("overwrite").parquet(f"{self.where}/ledger/batch={n}")

    def drained(self, spark: SparkSession) -> None:
        """Tries the waiting rows again until none waits."""
        done = self._batches(spark)
        while done and self._read(spark, "retry").filter(F.col("batch") == max(done)).head(1):
            nothing = self._read(spark, "retry").drop("batch", "tried", "first_batch").limit(0)
            self(nothing, max(done) + 1)
            done = self._batches(spark)

    def tables(self, spark: SparkSession) -> dict[str, DataFrame]:
        """The merged rows (of each key the newest), the rows that wait for another try, and those put aside."""
        done = self._batches(spark)
        known = spark.createDataFrame([(k,) for k in done], "batch int")
        out = {k: self._read(spark, k).join(F.broadcast(known), "batch") for k in self.KINDS}  # one row a batch
        rows = out["merged"]
        newest = F.struct("batch", *[c for c in rows.columns if c not in (*self.keys, "batch")])
        out["merged"] = rows.groupBy(*self.keys).agg(F.max(newest).alias("x")).select(*self.keys, "x.*")
        out["retry"] = out["retry"].filter(F.col("batch") == max(done))
        return out
