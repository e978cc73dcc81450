"""Document fingerprints by MinHash.

A text's shingles of five words are hashed; `HASHES` universal hash permutations x -> a x + b (mod 2 ** 32, a odd)
run over them in numpy, and the least value of each, cut to its upper 16 bits, is a part of the fingerprint. The
share of equal parts of two fingerprints estimates the Jaccard similarity of the two sets.

`BANDS` bands of `ROWS` parts are joined in Spark: texts that agree in a band are candidates, and their whole
shingle sets decide (`near_copies.joined`). A pair at a similarity of 0.8 shares no band with a probability of
(1 - 0.8 ** 5) ** 26, about 3e-5, a more similar one still less often.

Edited texts need the next document's text. A task takes the row that comes next where it lies, if that is in
order; the documents' true order, found from ids alone, then says which rows had their real neighbour. Only
the others (the ends of the parts of a table that lies in order; all rows of one that doesn't) are sorted by range
and done again, and what then lies at the end of a range, a few rows a range, once more in one part.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..store import compacted
from .common import checkpointed, flagged, release_memory, table, written
from .near_copies import BAND_BITS, SEED, SHINGLE, joined

HASHES, BANDS, ROWS = 130, 26, 5
#: Bytes of a fingerprint, and shingles that are permuted at a time.
WIDTH, SLICE = 2 * HASHES, 1024
#: Equal parts of two fingerprints that are compared whole; at a similarity of 0.8 fewer are equal about once in 100 million pairs.
LIKELY = 77
#: Up to how many rows are sorted in one part.
FEW = 2000
A, B = (np.random.default_rng(SEED).integers(0, 1 << 32, (2, HASHES), np.uint64) | np.array([[1], [0]], np.uint64)).astype(np.uint32)
NONE = np.full(HASHES, np.iinfo(np.uint32).max, np.uint32)
FIELDS = "doc_id long, hash long, n_chars long, n_shingles long, next_id long, next_hash long, edited_sha256 string, fingerprint binary, edited_fingerprint binary, near_edited double, near_next double"
_ARROW = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary(), "double": pa.float64()}
SCHEMA = pa.schema([(name, _ARROW[kind]) for name, kind in (f.split() for f in FIELDS.split(", "))])


def words_of(text: str) -> list[bytes]:
    """Runs of other than ASCII white space, A-Z lower-cased."""
    return text.encode("utf-8", "replace").lower().split()


def hashes(words: list[bytes]) -> np.ndarray:
    """XXH64 of each shingle, in the order of the text; fewer words than a shingle are one shingle, none have none."""
    if not words:
        return np.zeros(0, np.uint64)
    joined_words = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    k = min(SHINGLE, len(words))
    starts = np.concatenate([[0], ends[: len(words) - k] + 1]).tolist()
    of = xxhash.xxh64_intdigest
    return np.fromiter([of(joined_words[a:b], SEED) for a, b in zip(starts, ends[k - 1 :].tolist(), strict=True)], np.uint64, len(starts))


def minima(x: np.ndarray) -> np.ndarray:
    """The least value of each permutation over some hashes; of none, the largest number there is."""
    least, x = NONE, (x >> np.uint64(32)).astype(np.uint32)
    for at in range(0, len(x), SLICE):
        least = np.minimum(least, (x[at : at + SLICE, None] * A + B).min(0))
    return least


def packed(least: np.ndarray) -> bytes:
    return (least >> np.uint32(16)).astype(">u2").tobytes()


def fingerprint(text: str | None) -> bytes:
    """The fingerprint of a text; a null text, an empty one and one without a word have the same, of no shingles."""
    return packed(minima(hashes(words_of(text or ""))))


def likeness(a: bytes, b: bytes) -> float:
    """The share of equal parts of two fingerprints."""
    return float((np.frombuffer(a, ">u2") == np.frombuffer(b, ">u2")).mean())


class _Text:
    """A text with its shingles; minima over parts of them are shared by its own and the edited fingerprint."""

    def __init__(self, doc_id, hash_, text: str | None):
        self.doc_id, self.hash, self.text = doc_id, hash_, text or ""
        self.words = words_of(self.text)
        self.hashes = hashes(self.words)

    def parts(self, cuts: list[int]) -> None:
        """Sets minima of all shingles, and of those between any two of the cuts."""
        self.cuts = sorted({0, len(self.hashes), *(min(c, len(self.hashes)) for c in cuts)})
        self.least = [minima(self.hashes[a:b]) for a, b in zip(self.cuts[:-1], self.cuts[1:], strict=True)]
        self.fingerprint = packed(self.between(0, len(self.hashes)))

    def between(self, a: int, b: int) -> np.ndarray:
        out = NONE
        for start, part in zip(self.cuts, self.least, strict=False):
            if a <= start < b:
                out = np.minimum(out, part)
        return out


def _kept(t: _Text) -> tuple[list[bytes], int]:
    """The words of the part of a text that its edited text keeps, and how many shingles hold none of the last."""
    words = words_of(t.text[: len(t.text) - len(t.text) // 2])
    return words, max(0, len(words) - SHINGLE)


def _lent(t: _Text, before: _Text) -> tuple[list[bytes], int]:
    """The words that a text lends to the edited text of the one before, and the end of the shingles, from the second on, that hold no cut word."""
    words = words_of(t.text[: len(before.text) // 2])
    return words, max(1, len(words) - SHINGLE)


def _edited(t: _Text, after: _Text) -> tuple[str, np.ndarray]:
    """The edited text and its minima: those of the shingles that both texts have whole, and of the few at the seam and the end."""
    n = len(t.text)
    head, tail = t.text[: n - n // 2], after.text[: n // 2]
    (a, kept), (b, lent) = _kept(t), _lent(after, t)
    if len(a) <= SHINGLE or len(b) <= SHINGLE:
        return head + tail, minima(hashes(words_of(head + tail)))
    seam = [a[-1] + b[0]] if not head[-1] in " \t\n\v\f\r" and not tail[0] in " \t\n\v\f\r" else [a[-1], b[0]]
    least = np.minimum(t.between(0, kept), after.between(1, lent))
    few = np.concatenate([hashes(a[-SHINGLE:-1] + seam + b[1:SHINGLE]), hashes(b[-SHINGLE:])])
    return head + tail, np.minimum(least, minima(few))


def _pass(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of `FIELDS` from rows (doc_id, hash, text): each row with the one after it, the last with none."""

    def row(t: _Text, after: _Text | None) -> tuple:
        own = (t.doc_id, t.hash, len(t.text), len(np.unique(t.hashes)))
        if after is None:
            return *own, None, None, None, t.fingerprint, None, None, None
        text, least = _edited(t, after)
        edited = packed(least)
        sha = hashlib.sha256(text.encode("utf-8", "replace")).hexdigest()
        return *own, after.doc_id, after.hash, sha, t.fingerprint, edited, likeness(t.fingerprint, edited), likeness(t.fingerprint, after.fingerprint)

    last, out, size = None, [], 0
    for batch in batches:
        for doc_id, h, text in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "hash", "text")), strict=True):
            t = _Text(doc_id, h, text)
            t.parts([_kept(t)[1], *([1, _lent(t, last)[1]] if last is not None else [])])
            if last is not None:
                out.append(row(last, t))
                if len(out) >= 1000:
                    yield _batch(out)
                    out = []
            last = t
    if last is not None:
        yield _batch([*out, row(last, None)])
    del last, out
    release_memory()


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), SCHEMA, strict=True)], schema=SCHEMA)


def _pair(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of `FIELDS` from rows that hold both texts."""
    for batch in batches:
        for x in batch.to_pylist():
            two = pa.RecordBatch.from_pydict({"doc_id": [x["doc_id"], x["next_id"]], "hash": [x["hash"], x["next_hash"]], "text": [x["text"], x["next_text"]]})
            yield next(_pass(iter([two]))).slice(0, 1)


def _followers(prints: DataFrame) -> DataFrame:
    """(uid, doc_id, hash, next_id, next_hash, right): each row's successor in the order of (doc_id, hash), the first after the last; right: the pass had it."""
    order = ["doc_id", "hash"]
    rows = prints.select("uid", *order, F.col("next_id").alias("had_id"), F.col("next_hash").alias("had_hash"))
    rows = compacted(checkpointed(rows.repartitionByRange(*order).select("*", F.spark_partition_id().alias("range"))), 64)
    # one row a range
    firsts = rows.groupBy("range").agg(F.min(F.struct(*order)).alias("first")).orderBy("range").collect()
    ends = [(r["range"], after["first"]["doc_id"], after["first"]["hash"]) for r, after in zip(firsts, [*firsts[1:], *firsts[:1]], strict=True)]
    ends = prints.sparkSession.createDataFrame(ends, "range int, end_id long, end_hash long")
    at = Window.partitionBy("range").orderBy(*order)
    rows = rows.withColumns({"last": F.lead(F.lit(False), 1, True).over(at), "lead_id": F.lead("doc_id").over(at), "lead_hash": F.lead("hash").over(at)})
    rows = rows.join(F.broadcast(ends), "range")
    after = [F.when(F.col("last"), F.col(f"end_{c}")).otherwise(F.col(f"lead_{c}")).alias(f"next_{c}") for c in ("id", "hash")]
    rows = rows.select("uid", *order, *after, "had_id", "had_hash")
    right = F.col("had_id").eqNullSafe(F.col("next_id")) & F.col("had_hash").eqNullSafe(F.col("next_hash"))
    return rows.withColumn("right", right).drop("had_id", "had_hash").withColumn("link", F.xxhash64("doc_id", "hash", "next_id", "next_hash"))


def _same(a: DataFrame, b: DataFrame, *columns: str) -> F.Column:
    """Equality of the columns in both, nulls too; the first is a key."""
    out = a[columns[0]] == b[columns[0]]
    for c in columns[1:]:
        out &= a[c].eqNullSafe(b[c])
    return out


def edited_fingerprints(docs: DataFrame) -> DataFrame:
    """Rows of `FIELDS` for the rows of `docs` (doc_id, text): fingerprints of each text and of its edited text.

    The edited text has its last floor(n_chars / 2) code points replaced by the first as many (or all) of the next
    document in the order of doc_id, null first; rows with equal ids are ordered by a hash of the text, repeated rows follow each other,
    and a single row follows itself. A null text counts as empty. Other columns are not read; an empty table gives none.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("hash"), "text")
    prints = written(rows.mapInArrow(_pass, FIELDS).withColumn("uid", F.monotonically_increasing_id()))
    links = compacted(checkpointed(_followers(prints)), 64)
    wrong = links.filter("not right")
    key = ["link", "doc_id", "hash", "next_id", "next_hash"]
    todo = compacted(checkpointed(wrong.select(*key).distinct()), 64)
    marked = flagged(prints, "uid", wrong.select("uid"))
    good = marked.filter("not maybe").drop("maybe").unionByName(marked.filter("maybe").drop("maybe").join(wrong.select("uid"), "uid", "left_anti"))

    def texts_of(links: DataFrame) -> DataFrame:
        need = links.select("doc_id", "hash").unionAll(links.select(F.col("next_id").alias("doc_id"), F.col("next_hash").alias("hash"))).distinct()
        found = flagged(rows, "hash", need.select("hash")).filter("maybe").drop("maybe")
        return found.join(need, _same(found, need, "hash", "doc_id"), "left_semi").dropDuplicates(["doc_id", "hash"])

    done = []
    if todo.count() > FEW:
        order = ["doc_id", "hash"]
        again = texts_of(todo).repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(_pass, FIELDS)
        again = again.filter("edited_sha256 is not null").withColumn("link", F.xxhash64("doc_id", "hash", "next_id", "next_hash"))
        done.append(written(again))
        todo = compacted(checkpointed(todo.join(done[0], _same(todo, done[0], *key), "left_anti")), 64)
    texts = compacted(checkpointed(texts_of(todo)), 64 + F.coalesce(F.length("text"), F.lit(0)))
    own, after = texts, texts.select(F.col("doc_id").alias("next_id"), F.col("hash").alias("next_hash"), F.col("text").alias("next_text"))
    pairs = todo.join(own, _same(todo, own, "hash", "doc_id")).select(todo["*"], "text")
    pairs = pairs.join(after, _same(pairs, after, "next_hash", "next_id")).select(*[pairs[c] for c in key[1:]], "text", "next_text")
    done.append(written(pairs.mapInArrow(_pair, FIELDS).withColumn("link", F.xxhash64("doc_id", "hash", "next_id", "next_hash"))))
    for found in done:
        mended = wrong.join(found, _same(wrong, found, *key)).select(*[found[c] for c in found.columns if c != "link"], "uid")
        good = good.unionByName(mended.select(*good.columns))
    return good


def near_classes(prints: DataFrame, docs: DataFrame) -> DataFrame:
    """(hash, class_id) of the rows of `edited_fingerprints` whose near copies, or copies, are other rows too: class_id is the smallest doc_id that links reach.

    Texts whose shingle sets have a Jaccard similarity of 0.8 or more are linked; texts without a word are copies of each other.
    """
    band = lambda k: F.xxhash64(F.substring("fingerprint", 2 * ROWS * k + 1, 2 * ROWS)).bitwiseAND(F.lit(~BAND_BITS)).bitwiseOR(F.lit(k))
    texts = prints.filter("n_shingles > 0").select(F.col("hash").alias("cls"), F.col("n_shingles").alias("n"), F.array(*map(band, range(BANDS))).alias("keys"), F.col("fingerprint").alias("parts"))
    members = texts.select("cls", F.explode("keys").alias("key"))
    shared = compacted(checkpointed(members.groupBy("key").agg(F.min("cls").alias("low"), F.max("cls").alias("high")).filter("low <> high").select("key")), 16)
    members = flagged(members, "key", shared).filter("maybe").drop("maybe").join(shared, "key").distinct()
    members = compacted(checkpointed(members), 32)
    members = members.join(members.groupBy("key").agg(F.count(F.lit(1)).alias("k")), "key")
    active = members.select("cls").distinct()
    classes = flagged(texts, "cls", active).filter("maybe").drop("maybe").dropDuplicates(["cls"]).join(active, "cls")
    classes = compacted(checkpointed(classes.withColumn("fp", F.lit(0).cast("long"))), 512)
    roots = joined(members, classes, docs, LIKELY, ROWS)
    of = prints.select("doc_id", "hash", F.when(F.col("n_shingles") == 0, 0).otherwise(F.col("hash")).alias("node"))
    of = of.groupBy("node", "hash").agg(F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("rows")).join(roots, "node", "left").withColumn("root", F.coalesce("component", "node"))
    of = compacted(checkpointed(of.select("root", "hash", "doc_id", "rows")), 40)
    groups = of.groupBy("root").agg(F.min("doc_id").alias("class_id"), F.sum("rows").alias("rows")).filter("rows > 1")
    return compacted(checkpointed(of.select("root", "hash").join(groups, "root").select("hash", "class_id")), 24)


def fingerprints_of_documents(docs: DataFrame) -> DataFrame:
    """One row per row of `docs` (doc_id, text): the columns of `op11_minhash`, class_id among them (the document's own id if it has no near copy).

    Nulls, ties, repeated rows and an empty table as in `edited_fingerprints`; the class of rows whose ids are all null has a null class_id.
    """
    prints = edited_fingerprints(docs)
    classes = near_classes(prints, docs)
    marked = flagged(prints, "hash", classes.select("hash"))
    some = marked.filter("maybe").drop("maybe").join(classes, "hash", "left").withColumn("class_id", F.coalesce("class_id", "doc_id"))
    out = marked.filter("not maybe").drop("maybe").withColumn("class_id", F.col("doc_id")).unionByName(some)
    prints_ = [F.lower(F.hex(c)).alias(c) for c in ("fingerprint", "edited_fingerprint")]
    return out.select("doc_id", "n_chars", "edited_sha256", *prints_, "near_edited", "near_next", "class_id")


def op11_minhash(spark, sf_dir: str) -> DataFrame:
    return fingerprints_of_documents(table(spark, sf_dir, "documents"))
