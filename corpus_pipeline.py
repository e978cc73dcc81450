"""A training corpus from raw documents, in five stages.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before kept; its result is
written as Parquet and read again as the next one's docs.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scholarflow.llm import op1_language, op2_secrets, op7_pieces, op9_simhash, op10_mixing
from scholarflow.llm.common import held_out, packed, table, unpacked, written


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents without text, or without a letter in it; no score of PPM takes part in that.

    A missing lang becomes the predicted one, the only decision taken by PPM scores. The models learn from
    docs' own labels that are not held out; if there are none, a missing lang stays null. Null ids are kept, and
    repeated rows are judged alike; other columns, whatever their names, come back as they were.
    """
    model = op1_language.train(docs.filter(~held_out(F.col("doc_id"))))
    kept = op1_language.identify(packed(docs), model, "row.text").filter("not _out.lang_pred <=> 'und'")
    return unpacked(kept, docs.columns, lang=F.coalesce("row.lang", "_out.lang_pred"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near copies (five-word shingles, Jaccard similarity of 0.8 or more), the one with the smallest doc_id.

    A null id goes if its group has another; texts without a word are copies of each other; of repeated rows one
    stays. Other columns come back as they were.
    """
    return op9_simhash.keep_one(docs)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces every secret in the texts by `[SECRET]`, with n_chars to match; all documents stay.

    A null text stays null, and so does its n_chars then; an empty one stays empty. Other columns come back as they were.
    """
    found = op2_secrets.scan_secrets(packed(docs), "row.text")
    return unpacked(found, docs.columns, text=F.col("_out.redacted"), n_chars=F.length("_out.redacted").cast("long"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix of the sources takes it: not at all, or up to three times.

    Texts without a word, null ones too, have nothing to take and go. A null source is a source. Other columns
    come back as they were, whatever their names.
    """
    mixed = op10_mixing.mix(packed(docs, "doc_id", "text", "source"), F.array("source")).filter("_out.copies > 0")
    return unpacked(mixed.select("row", F.explode(F.sequence(F.lit(1), F.col("_out.copies")))), docs.columns)


def pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id and SentencePiece ids, end id included, of every document; a null or empty text has the end id only."""
    coded = op7_pieces.encode_documents(docs.select("doc_id", "text"), op7_pieces.model_path())
    return coded.select("doc_id", F.size("_out.ids").cast("long").alias("n_tokens"), F.col("_out.ids").alias("ids"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("secrets", secrets),
    ("mixing", mixing),
    ("pieces", pieces),
]

#: SQL can express neither PPM code lengths nor BPE merges; the stages are tested one by one instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = written(docs)
    return docs
