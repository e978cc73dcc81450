"""Containment of names, archive search, section trees, course files and ranks against plain Python."""

from __future__ import annotations

import numpy as np
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from scholarflow.operators import analytics, text
from scholarflow.sources import tables
from scholarflow.store import new_folder


def pairs(spark, names, **kw):
    return {(r["outer"], r["inner"]) for r in text.containing_names(spark.createDataFrame([(x,) for x in names], "name string"), **kw).collect()}


def test_every_containing_pair_of_names(spark):
    rng = np.random.default_rng(3)
    names = {"".join(rng.choice(list("abcÄ "), rng.integers(1, 9))) for _ in range(150)} | {"a", "ab", "Graph Theory", "theory", "RAPH", "graph theory"}
    low = {n.lower() for n in names}
    want = {(a, b) for a in low for b in low if a != b and b in a}
    assert pairs(spark, [*names, None, "", "a"]) == want


def test_one_short_name_that_nearly_all_hold_is_split(spark):
    names = ["q"] + [f"q{k}x" for k in range(400)]
    assert pairs(spark, names, split=16) == {(n, "q") for n in names[1:]}


def test_archive_search_takes_ten_of_each(spark):
    vector = [(1, f"v{k:02}", 0.71 + k / 100) for k in range(25)] + [(1, "low", 0.5), (2, "only", 0.69)]
    keyword = [(1, f"k{k}", k) for k in range(12)] + [(1, "v24", 99), (2, "word", 1)]
    df = text.hybrid_search(spark.createDataFrame(vector, "query int, content string, score double"), spark.createDataFrame(keyword, "query int, content string, date int"))
    got = [(r["content"], r["source"], r["page"]) for r in df.filter("query = 1").orderBy("rank").collect()]
    # the newest keyword hit is one of the vector hits, so nine are left of ten
    assert [c for c, s, _ in got if s == "vector"] == [f"v{k}" for k in range(24, 14, -1)]
    assert [c for c, s, _ in got if s == "keyword"] == [f"k{k}" for k in range(11, 2, -1)]
    assert [p for *_, p in got] == [k // 5 for k in range(19)]
    assert [(r["content"], r["source"], r["score"]) for r in df.filter("query = 2").collect()] == [("word", "keyword", 1.0)]


def test_archive_search_of_one_and_one(spark):
    df = text.hybrid_search(spark.createDataFrame([(1, "a", 0.9)], "query int, content string, score double"), spark.createDataFrame([(1, "b", 5)], "query int, content string, date int"))
    assert [(r["content"], r["score"], r["page"]) for r in df.orderBy("rank").collect()] == [("a", 0.9, 0), ("b", 1.0, 0)]


def test_sections_are_ordered_by_number_whatever_their_length(spark):
    ids = [5, 100000005, 100000009, 123456789012, 99999999999]
    rows = [(1, 1, None, "root")] + [(1, k, 1, f"t{k}") for k in ids] + [(1, 7, 100000009, "leaf")]
    got = text.tree_sections(spark.createDataFrame(rows, "doc_id long, node long, parent long, title string")).orderBy("pos").collect()
    assert [r["node"] for r in got] == [1, 5, 100000005, 100000009, 7, 99999999999, 123456789012]


def test_materials_come_back_whole(spark):
    texts = {"a_b.md": "# One\n\ntwo\r\nthree \u00e4\n", "empty.md": "", "long.md": "x y\n" * 50_000}
    where = new_folder(spark, "materials-test")
    rows = spark.createDataFrame([("Course 1", k, v) for k, v in texts.items()], "course string, filename string, content string")
    assert tables.write_materials(rows, where) == 3
    got = {r["filename"]: r for r in tables.materials(spark, where).collect()}
    del texts["empty.md"]  # Spark reads nothing of an empty file
    assert {k: r["content"] for k, r in got.items()} == texts
    assert got["a_b.md"]["title"] == "A B" and got["a_b.md"]["course_id"] == "course-1"
    with pytest.raises(Exception, match="no file name"):
        tables.write_materials(rows.withColumn("filename", F.lit("../x")), where)


def test_archived_materials_are_those_of_loose_files_in_few_files(spark):
    texts = {"a_b.md": "# One\n\ntwo\r\nthree \u00e4\n", "long.md": "x y\n" * 50_000, "\u00e4 +%20-c.md": "\ufeffz", "n" * 150 + ".md": "\u6f22"}
    rows = spark.createDataFrame([(c, k, v) for c in ("Course 1", "\u00d6") for k, v in texts.items()], "course string, filename string, content string")
    loose = new_folder(spark, "materials-test")
    tables.write_materials(rows, loose)
    want = sorted(map(tuple, tables.materials(spark, loose).collect()))
    for size, most in ((1 << 20, 2), (1000, 8)):
        archives = tables.archive_materials(rows.repartition(2), new_folder(spark, "archives-test"), size)
        assert archives.count() <= most and archives.agg(F.sum("n")).first()[0] == len(want) == 8
        assert sorted(map(tuple, tables.archived_materials(archives).collect())) == want
    odd = tables.archive_materials(spark.createDataFrame([("", "a.md", None), ("c", "b.md", "")], rows.schema), new_folder(spark, "archives-test"))
    assert {(r["course_id"], r["filename"], r["content"]) for r in tables.archived_materials(odd).collect()} == {("", "a.md", ""), ("c", "b.md", "")}
    for bad in ("../x", "", None):
        with pytest.raises(Exception, match="no file name"):
            tables.archive_materials(rows.withColumn("filename", F.lit(bad).cast("string")), new_folder(spark, "archives-test"))


def test_the_query_of_materials_opens_no_file_a_document(spark, sf_dir):
    import __spark_entry__ as entry
    from scholarflow.store import shared_folder

    before = {p for p in Path(shared_folder(spark).removeprefix("file:")).glob("materials-*/**/*") if p.is_file()}
    rows = entry.queries()["src_materials"](spark, sf_dir).count()
    made = {p for p in Path(shared_folder(spark).removeprefix("file:")).glob("materials-*/**/*") if p.is_file()} - before
    assert 0 < len(made) < 50 < rows


@pytest.mark.parametrize("hot", [0.1, 0.97])
def test_ranks_of_a_hot_key(spark, hot):
    import pandas as pd

    rng = np.random.default_rng(5)
    n = 3000
    frame = pd.DataFrame({"k": np.where(rng.random(n) < hot, 0, rng.integers(1, 4, n)), "grade": rng.integers(0, 40, n) / 8, "reference": rng.random(n), "length": np.where(rng.random(n) < 0.7, 1, rng.integers(0, 500, n))})
    frame["reference"] += frame["grade"]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        df = spark.createDataFrame(frame)
        ranks = {(r["k"], r["length"]): r["rank"] for r in analytics.fractional_ranks(df, ["k"], "length").collect()}
        got = {r["k"]: r for r in analytics.grader_quality(df, ["k"]).collect()}
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    for k, rows in frame.groupby("k"):
        for length, rank in zip(rows["length"], rows["length"].rank(), strict=True):
            assert ranks[k, length] == rank
        r = rows.rank()
        assert abs(got[k]["rho"] - r["grade"].corr(r["reference"])) < 1e-9 and abs(got[k]["length_bias"] - r["grade"].corr(r["length"])) < 1e-9
        assert abs(got[k]["spread"] - rows["grade"].std()) < 1e-9


def test_scores_of_free_answers(spark):
    from scholarflow.functions import more_rules

    cases = {"Score 8 of 10\n99": (1.0, 1.0), "7": (0.07, 0.5), "0.35 I think": (0.35, 0.35), "007": (0.07, 0.0), "none\n5": (0.5, 0.5), "": (0.5, 0.5), None: (0.5, 0.5), "12345678901234567890": (1.0, 1.0)}
    df = spark.createDataFrame([(t,) for t in cases], "t string")
    got = {r["t"]: (round(r["a"], 6), round(r["b"], 6)) for r in df.select("t", more_rules.first_line_score(F.col("t")).alias("a"), more_rules.probability(F.col("t")).alias("b")).collect()}
    assert got == cases
