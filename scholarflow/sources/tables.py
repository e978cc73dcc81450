"""Reading and writing the engine's tables with explicit schemas."""

from __future__ import annotations

import io
import tarfile
import uuid
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..store import checkpointed

#: Bytes of texts in an archive before the next one begins, and in a batch of texts read from it.
ARCHIVE, BATCH = 64 << 20, 8 << 20
LEARNERS = "learner_id string, profile string, created_at timestamp, updated_at timestamp"
PATHS = "learner_id string, created_at timestamp, path string"
PATH_STEPS = "array<struct<concept:string,day:int,estimated_hours:double,difficulty:int>>"
RUNS = """experiment_id string, started_at timestamp, completed_at timestamp, config struct<use_real_llm:boolean,learner_filter:string,use_baseline:boolean>,
  phases map<string,string>, metrics struct<experiment_duration_seconds:double,agents:map<string,struct<total_calls:int,success_rate:double,avg_latency_ms:double>>>, _corrupt_record string"""
TESTS = "test_id string, test_name string, difficulty string, time_limit_minutes int, questions array<struct<id:string,type:string,question:string,options:array<string>,correct_answer:string,points:int>>"


def runs(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """Experiment runs (one JSON document per file, or else per line) as a summary; missing numbers are 0, unreadable documents fail."""
    raw = spark.read.schema(RUNS).option("multiLine", multi_line).option("mode", "PERMISSIVE").json(path)
    agent = lambda n: F.coalesce(F.col("metrics.agents")[n]["avg_latency_ms"], F.lit(0.0)).alias(f"{n}_ms")
    return raw.select(
        "experiment_id", F.coalesce("started_at", "completed_at").alias("at"), F.when(F.col("config.use_real_llm"), "real").otherwise("mock").alias("mode"), F.when(F.col("config.use_baseline"), "baseline").otherwise("full").alias("type"),
        F.col("config.learner_filter").alias("learner"), F.coalesce("metrics.experiment_duration_seconds", F.lit(0.0)).alias("duration"), *[agent(n) for n in ("knowledge_extraction", "profiler", "tutor")],
        F.when(F.col("_corrupt_record").isNotNull() | F.col("experiment_id").isNull(), "failed").otherwise("success").alias("status"),
    )


def course_tests(spark: SparkSession, path: str) -> DataFrame:
    raw = spark.read.schema(TESTS).option("multiLine", True).json(path)
    return raw.select("test_id", F.explode("questions").alias("q")).select("test_id", "q.*")


def materials(spark: SparkSession, path: str) -> DataFrame:
    """Whole text files with a title from the file name, and the course and concept ids of the path. An empty file gives no row: Spark reads none of it."""
    # the path is a uri, in which a plus sign stands for itself
    parts = F.split(F.url_decode(F.replace("_metadata.file_path", F.lit("+"), F.lit("%2B"))), "/")
    return _described(spark.read.text(path, wholetext=True, recursiveFileLookup=True), parts, F.col("value"))


def _described(raw: DataFrame, parts: Column, content: Column) -> DataFrame:
    """What the parts of a file's path, its course and its name at the end, say of each text."""
    stem = F.regexp_replace(F.element_at(parts, -1), r"\.[^.]*$", "")
    slug = lambda c: F.regexp_replace(F.lower(c), "[^a-z0-9]+", "-")
    return raw.select(F.element_at(parts, -1).alias("filename"), F.initcap(F.translate(stem, "_-", "  ")).alias("title"), slug(F.element_at(parts, -2)).alias("course_id"), slug(stem).alias("concept_id"), content.alias("content"))


def archive_materials(rows: DataFrame, path: str, size: int = ARCHIVE) -> DataFrame:
    """Writes each row (course, filename, content) as a file of UTF-8 into tar archives in `path`; (archive, n) of what was written.

    A file of its own for each text costs some milliseconds to write, list and open; an archive is opened once for `size` bytes of texts.
    `path` is in a folder that all executors share. Archives of a task that failed or ran twice stay behind and are not in the result, so that each row is in one.
    A null content is an empty file; a null course, or a file name that is null or empty, is an error.
    """

    def save(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store, top = _file_system(path)
        store.create_dir(top, recursive=True)
        files = ((c, n, (t or "").encode("utf-8")) for b in batches for c, n, t in zip(b["course"], b["filename"], b["content"], strict=True))
        more = next(files, None)
        while more is not None:
            name, n, held = uuid.uuid4().hex + ".tar", 0, 0
            with store.open_output_stream(f"{top}/{name}") as f, tarfile.open(fileobj=f, mode="w|") as tar:
                while more is not None and held < size:
                    course, filename, content = more
                    if course is None or not filename or {"/", "\0"} & set(course + filename):
                        raise ValueError(f"no file name: {course}, {filename}")
                    member = tarfile.TarInfo(f"materials/{course}/{filename}")
                    member.size = len(content)
                    tar.addfile(member, io.BytesIO(content))
                    n, held, more = n + 1, held + len(content), next(files, None)
            yield pd.DataFrame({"archive": [f"{path}/{name}"], "n": [n]})

    return checkpointed(rows.select("course", "filename", "content").mapInPandas(save, "archive string, n long"))


def archived_materials(archives: DataFrame) -> DataFrame:
    """The texts of `archive_materials` whole, with the columns of `materials`; an empty file gives an empty text."""

    def batch(names: list[str], texts: list[str]) -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({"name": pa.array(names, pa.string()), "content": pa.array(texts, pa.string())})

    def load(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for archive in (x for b in batches for x in b.column("archive").to_pylist()):
            store, where = _file_system(archive)
            with store.open_input_stream(where) as f, tarfile.open(fileobj=f, mode="r|") as tar:
                names, texts, held = [], [], 0
                for member in tar:
                    names.append(member.name)
                    texts.append(tar.extractfile(member).read().decode("utf-8"))
                    held += member.size
                    if held > BATCH:
                        yield batch(names, texts)
                        names, texts, held = [], [], 0
                yield batch(names, texts)

    raw = archives.select("archive").mapInArrow(load, "name string, content string")
    return _described(raw, F.split("name", "/"), F.col("content"))


def write_materials(rows: DataFrame, path: str) -> int:
    """Writes each row (course, filename, content) to `path`/course/filename as UTF-8; the number of files.

    `path` is in a folder that all executors share. A file appears under its name when it is whole, so a task that runs twice, or two rows
    of one name, leave one of the contents. A null content is an empty file; a null course or file name is an error.
    """

    def save(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store, top = _file_system(path)
        for batch in batches:
            for course, name, content in zip(batch["course"], batch["filename"], batch["content"], strict=True):
                if "/" in f"{course}{name}" or course is None or name is None:
                    raise ValueError(f"no file name: {course}, {name}")
                store.create_dir(f"{top}/{course}", recursive=True)
                part = f"{top}/{course}/.{name}-{uuid.uuid4().hex}"
                with store.open_output_stream(part) as f:
                    f.write((content or "").encode("utf-8"))
                store.move(part, f"{top}/{course}/{name}")
            yield pd.DataFrame({"n": [len(batch)]})

    return rows.select("course", "filename", "content").mapInPandas(save, "n long").agg(F.sum("n")).first()[0] or 0


def _file_system(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system and the path in it of a folder that executors share."""
    return (fs.LocalFileSystem(), "/" + uri[5:].lstrip("/")) if uri.startswith("file:") else (fs.LocalFileSystem(), uri) if uri.startswith("/") else fs.FileSystem.from_uri(uri)


def path_steps(paths: DataFrame) -> DataFrame:
    """Saved paths (learner_id, created_at, path JSON) as one row per step."""
    return paths.select("learner_id", "created_at", F.posexplode(F.from_json("path", PATH_STEPS)).alias("pos", "s")).select("learner_id", "created_at", "pos", "s.*")


def append(df: DataFrame, path: str, time: str) -> None:
    """Appends facts, partitioned by day."""
    df.withColumn("day", F.to_date(time)).write.mode("append").partitionBy("day").parquet(path)


def chunk_index(chunks: DataFrame, path: str, buckets: int = 64) -> None:
    """Persists chunks partitioned by a bucket of the document, so that one document is one small read."""
    chunks.withColumn("bucket", F.pmod(F.xxhash64("doc_id"), F.lit(buckets))).repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(path)


def stage(df: DataFrame, folder: str, extraction: str) -> None:
    """Writes the rows of one extraction to the staging part of `folder`; nobody reads them before the commit."""
    df.write.mode("overwrite").parquet(f"{folder}/staging/extraction={extraction}")


def published(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/published")


def commit(spark: SparkSession, folder: str, extraction: str, key: str) -> None:
    """Merges a staged extraction into the published table by `key` (its rows win), swaps the table, deletes the staging rows.

    The merged table is written beside the published one and takes its place by a rename, so that readers see
    whole tables only; a commit that dies before the swap leaves the staging rows, and can be run again.
    """
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path
    fs = path(folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    staged, now, merged, before = (path(f"{folder}/{p}") for p in (f"staging/extraction={extraction}", "published", "merged", "before"))
    if not fs.exists(now) and fs.exists(before):
        fs.rename(before, now)  # a commit died between the two renames
    fs.delete(before, True)
    new = spark.read.parquet(staged.toString())
    if fs.exists(now):
        new = published(spark, folder).join(new.select(key), key, "left_anti").unionByName(new, allowMissingColumns=True)
    new.write.mode("overwrite").parquet(merged.toString())
    if fs.exists(now):
        fs.rename(now, before)
    if not fs.rename(merged, now):
        raise OSError(f"{merged.toString()} could not be renamed")
    fs.delete(before, True)
    fs.delete(staged, True)


def alerts(df: DataFrame, path: str) -> None:
    """JSON lines."""
    df.write.mode("append").json(path)
