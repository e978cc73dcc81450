"""SimHash near copies at shingle similarity: the operator of `op9_simhash` for five-word shingles and 0.8.

Two texts are near copies if their sets of five-word shingles have a Jaccard similarity of 0.8 or more; such
a pair differs in about 9.7 of 64 SimHash bits, and in more than `RADIUS` about once in a million pairs. No
exact block keys reach that far (21 parts of a fingerprint would have to agree in one), so blocks are the
texts that agree in the `ROWS` least hashes of one of `BANDS` bands: a pair at 0.8 shares no block with
probability (1 - 0.8 ** 4) ** 32, about 5e-8, a more similar one still less often.

1. Texts with equal sets are one class. Blocks of one class are dropped before anything else moves.
2. Each class is held against one centre, the member of its blocks that most other blocks share (the
   original, where copies were made of one): the bit planes of their fingerprints first, then the two sets.
3. Blocks with classes that no link has joined yet are compared whole: bit planes give the pairs within the
   radius (`planes.within`), each pair in the first block where it meets only, and the sets decide.

A class's text goes to tasks once for 2 and once for each block of 3; large blocks are cut into pairs of
parts, and no task lists pairs: each returns a spanning forest of the links that it has verified.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..store import compacted
from .buckets import forest, small_pairs, stream
from .common import block_pairs, checkpointed, components, dealt, flagged, packed, release_memory, unpacked, with_columns_from
from .planes import planes_of, within

SEED, SHINGLE, BANDS, ROWS, RADIUS = 42, 5, 32, 4, 28
#: Least similarity, as a fraction.
NUM, DEN = 4, 5
#: Weight of a part of a large block (a text weighs 1, and 1 more for each 256 shingles), and up to how many rows a block is small.
BLOCK, SMALL = 512, 24
#: Bits of a key that hold its band's number, where they are needed.
BAND_BITS = 31
#: Members that are held against one copy of their centre.
STAR = 500
#: Shingles, or pairs, that are worked on at a time.
SLICE = 1024
FACTORS = np.random.default_rng(SEED).integers(0, 1 << 63, (BANDS * ROWS, 2), np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1)
SKETCH = T.StructType([T.StructField("cls", T.LongType()), T.StructField("n", T.LongType()), T.StructField("fp", T.LongType()), T.StructField("keys", T.ArrayType(T.LongType()))])


def shingles(text: str | None) -> np.ndarray:
    """The sorted distinct hashes of a text's shingles; words as in `op9_simhash.fingerprint`."""
    words = (text or "").encode("utf-8", "replace").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    k = min(SHINGLE, len(words))
    starts = np.concatenate([[0], ends[: len(words) - k] + 1]).tolist()
    of = xxhash.xxh64_intdigest
    return np.unique(np.fromiter([of(joined[a:b], SEED) for a, b in zip(starts, ends[k - 1 :].tolist(), strict=True)], np.uint64, len(starts)))


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    """True if two sets (sorted, distinct) have a Jaccard similarity of at least NUM / DEN."""
    if DEN * min(len(a), len(b)) < NUM * max(len(a), len(b)):
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return DEN * both >= NUM * (len(a) + len(b) - both)


def sketch(text: str | None) -> tuple:
    """The class (a digest of the set), the set's size, its SimHash and the bands' block keys."""
    x = shingles(text)
    cls = int(np.uint64(xxhash.xxh64_intdigest(x.tobytes(), SEED)).astype(np.int64))
    if not len(x):
        return cls, 0, 0, []
    least = np.full(len(FACTORS), np.iinfo(np.uint64).max, np.uint64)
    ones = np.zeros(64, np.int64)
    for at in range(0, len(x), SLICE):
        part = x[at : at + SLICE]
        least = np.minimum(least, (part[:, None] * FACTORS[:, 0] + FACTORS[:, 1]).min(0))
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    fp = np.packbits(2 * ones > len(x), bitorder="little").view(np.int64)[0]
    keys = [xxhash.xxh64_intdigest(band.tobytes(), i) for i, band in enumerate(least.reshape(BANDS, ROWS))]
    return cls, len(x), int(fp), np.array(keys, np.uint64).astype(np.int64).tolist()


def _texts(active: DataFrame, docs: DataFrame) -> DataFrame:
    """(cls, text) of the classes of `active` (cls, hash; without hash, cls is that of its text); only texts that may be needed are shuffled, one of each hash.

    They are dealt by cls, so that later joins on cls leave them where they lie.
    """
    key = "hash" if "hash" in active.columns else "cls"
    found = flagged(docs.select("text", F.xxhash64("text").alias(key)), key, active.select(key)).filter("maybe")
    texts = found.select("text", key).dropDuplicates([key]).join(active.select(*dict.fromkeys((key, "cls"))), key).select("cls", "text")
    return dealt(texts, "cls")


def _near_centres(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The rows whose differences (bits) from their centre are within the radius, by the planes of the differences against a query of zero."""
    for batch in batches:
        if len(batch):
            _, c = within(planes_of(batch["bits"].to_numpy()), np.zeros(1, np.uint64), RADIUS)
            yield batch.iloc[c[c < len(batch)]]


def _stars(stars: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (a, b) of `stars` that are similar: the text of each centre a goes before those of at most about `STAR` of its members b."""
    parts = stars.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / STAR).cast("int").alias("parts"))
    members = stars.join(parts, "a").select("a", F.pmod(F.xxhash64("b"), F.col("parts")).cast("int").alias("part"), F.lit(1).alias("kind"), F.col("b").alias("cls")).join(texts, "cls")
    centres = parts.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).select("a", "part", F.lit(0).alias("kind"), F.col("a").alias("cls")).join(texts, "cls")
    rows = members.unionByName(centres).repartition("a", "part").sortWithinPartitions("a", "part", "kind")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = np.zeros(0, np.uint64)
        for batch in batches:
            good = np.zeros(len(batch), bool)
            for k, (kind, text) in enumerate(zip(batch["kind"], batch["text"], strict=True)):
                if kind == 0:
                    held = shingles(text)
                else:
                    good[k] = similar(held, shingles(text))
            yield pd.DataFrame({"a": batch["a"][good], "b": batch["cls"][good]})
        release_memory()

    return checkpointed(rows.select("a", "kind", "cls", "text").mapInPandas(run, "a long, b long"))


def _similar_pairs(texts: list, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Which of the pairs of texts are similar; many pairs of few texts are counted by a product of matrices."""
    sets = {int(k): shingles(texts[k]) for k in np.unique(np.concatenate([i, j]))}
    if len(i) <= 4 * len(sets):
        return np.array([similar(sets[a], sets[b]) for a, b in zip(i.tolist(), j.tolist(), strict=True)], bool)
    left, right = np.unique(i), np.unique(j)
    size = np.zeros(len(texts), np.int64)
    for k, s in sets.items():
        size[k] = len(s)
    row = np.repeat(list(sets), [len(s) for s in sets.values()])
    ids, of, n = np.unique(np.concatenate(list(sets.values())), return_inverse=True, return_counts=True)
    shared = np.flatnonzero(n > 1)
    place = np.full(len(ids), -1)
    place[shared] = np.arange(len(shared))
    column = place[of]
    row, column = row[column >= 0], column[column >= 0]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    at_left, at_right = (np.full(len(texts), -1) for _ in range(2))
    at_left[left], at_right[right] = np.arange(len(left)), np.arange(len(right))
    both = np.zeros((len(left), len(right)), np.float32)
    for start in range(0, len(shared), 2048):
        lo, hi = np.searchsorted(column, (start, start + 2048))
        r, c = row[lo:hi], column[lo:hi] - start
        sides = []
        for at, many in ((at_left, len(left)), (at_right, len(right))):
            m = np.zeros((many, 2048), np.float32)
            own = at[r] >= 0
            m[at[r[own]], c[own]] = 1
            sides.append(m)
        both += sides[0] @ sides[1].T
    common = both[at_left[i], at_right[j]].astype(np.int64)
    return DEN * common >= NUM * (size[i] + size[j] - common)


def _links(rows: pd.DataFrame, group: np.ndarray, large: bool) -> pd.DataFrame | None:
    """A spanning forest (a, b) of the links between rows of small blocks, or between the two parts of a large one."""
    x, n, root, key = (rows[c].to_numpy() for c in ("fp", "n", "root", "key"))
    keys = np.array(rows["keys"].tolist(), np.int64)
    if large:
        bi, bj = rows["block_i"].iloc[0], rows["block_j"].iloc[0]
        left, right = (np.flatnonzero(rows["own"].to_numpy() == b) for b in (bi, bj))
        planes = planes_of(x[right])
        near = []
        for at in range(0, len(left), 64):
            q, c = within(planes, x[left[at : at + 64]], RADIUS)
            keep = c < len(right)
            near.append((left[at + q[keep]], right[c[keep]]))
        i, j = (np.concatenate(z) for z in zip(*near, strict=True)) if near else (np.zeros(0, int), np.zeros(0, int))
        if bi == bj:
            i, j = i[i < j], j[i < j]
    else:
        i, j = small_pairs(group)
        near = [np.zeros(0, int)]
        for at in range(0, len(i), 1 << 17):
            # the planes of the differences, against a query of zero
            _, c = within(planes_of(x[i[at : at + (1 << 17)]] ^ x[j[at : at + (1 << 17)]]), np.zeros(1, np.uint64), RADIUS)
            near.append(c[c < min(1 << 17, len(i) - at)] + at)
        i, j = i[np.concatenate(near)], j[np.concatenate(near)]
    ok = (root[i] != root[j]) & (DEN * np.minimum(n[i], n[j]) >= NUM * np.maximum(n[i], n[j]))
    i, j = i[ok], j[ok]
    first = [np.zeros(0, bool)]
    for at in range(0, len(i), 1 << 15):
        a, b = i[at : at + (1 << 15)], j[at : at + (1 << 15)]
        band = (keys[a] == keys[b]).argmax(1)
        first.append(keys[a, band] == key[a])
    first = np.concatenate(first)
    i, j = i[first], j[first]
    if not len(i):
        return None
    ok = _similar_pairs(rows["text"].tolist(), i, j)
    tree = forest(len(x), i[ok], j[ok])
    own = np.flatnonzero(tree != np.arange(len(x)))
    cls = rows["cls"].to_numpy()
    return pd.DataFrame({"a": cls[own], "b": cls[tree[own]]}) if len(own) else None


def _with_partners(rows: pd.DataFrame, group: np.ndarray, large: bool, likely: int, width: int) -> pd.DataFrame | None:
    """The rows (key, cls) of blocks that have a partner with another root, at least `likely` equal parts, and no earlier band of `width` parts in common."""
    x, root = np.array([np.frombuffer(p, np.uint16) for p in rows["parts"]]), rows["root"].to_numpy()
    band = rows["key"].to_numpy() & BAND_BITS
    good = np.zeros(len(rows), bool)

    def mark(i: np.ndarray, j: np.ndarray) -> None:
        first = (x[i] == x[j]).reshape(len(i), -1, width).all(2).argmax(1) == band[i]
        good[i[first]] = good[j[first]] = True

    if large:
        bi, bj = rows["block_i"].iloc[0], rows["block_j"].iloc[0]
        left, right = (np.flatnonzero(rows["own"].to_numpy() == b) for b in (bi, bj))
        columns = np.ascontiguousarray(x[right].T)
        for at in left.tolist():
            equal = np.zeros(len(right), np.uint8)
            for k, part in enumerate(x[at]):
                equal += columns[k] == part
            j = right[(equal >= likely) & (root[right] != root[at])]
            if len(j):
                mark(np.full(len(j), at), j)
    else:
        i, j = small_pairs(group)
        for at in range(0, len(i), SLICE):
            a, b = i[at : at + SLICE], j[at : at + SLICE]
            near = ((x[a] == x[b]).sum(1) >= likely) & (root[a] != root[b])
            if near.any():
                mark(a[near], b[near])
    return rows.loc[good, ["key", "cls"]] if good.any() else None


def groups(docs: DataFrame) -> DataFrame:
    """Rows of `docs` (doc_id, text) as doc_id, text_hash, root (the same for all that links of near copies join).

    Null and empty texts, and texts without a word, are one class; so are equal texts. Other columns are not read.
    """
    found = with_columns_from(docs.select("doc_id", "text"), "text", SKETCH, lambda: lambda values: [sketch(v) for v in values])
    prints = checkpointed(found.select("doc_id", F.xxhash64("text").alias("text_hash"), "_out.*"))
    classes = checkpointed(prints.groupBy("cls").agg(F.min("text_hash").alias("hash"), F.first("n").alias("n"), F.first("fp").alias("fp"), F.first("keys").alias("keys")))
    members = classes.select("cls", F.explode("keys").alias("key"))
    # nearly all blocks have one member; only the others go on
    members = checkpointed(members.join(members.groupBy("key").agg(F.count(F.lit(1)).alias("k")).filter("k > 1"), "key"))
    roots = joined(members, classes, docs).withColumnRenamed("node", "cls")
    return prints.select("doc_id", "text_hash", "cls").join(roots, "cls", "left").select("doc_id", "text_hash", F.coalesce("component", "cls").alias("root"))


def joined(members: DataFrame, classes: DataFrame, docs: DataFrame, likely: int = 0, width: int = 1) -> DataFrame:
    """(node, component) of the classes that verified links join.

    `members` (key, cls, k: members of the block) are the blocks of more than one class; `classes` has cls, hash (of one of its
    texts in `docs`; not needed if cls is that), n (shingles), fp and keys (in one order for all) of these classes at least. Equal fp pass every comparison of bits.
    With a column `parts` (2-byte parts of a MinHash fingerprint, `width` a band, 255 at most; the lowest bits of a key are its band's number), only texts
    with a partner that has `likely` equal parts, and meets them in this block first, are compared whole; the others' texts don't move.
    """
    active = compacted(checkpointed(members.groupBy("cls").agg(F.sum("k").alias("met")).join(classes, "cls")), 512)
    members = compacted(checkpointed(members.select("key", "cls").join(active.select("cls", "met", "n", "fp"), "cls")), 64)
    centre = members.groupBy("key").agg(F.max(F.struct("met", "cls", "n", "fp")).alias("c"))
    held = members.join(centre, "key").filter("cls <> c.cls")
    held = held.filter(F.least("n", "c.n") * DEN >= F.greatest("n", "c.n") * NUM)
    held = held.select("cls", F.col("fp").bitwiseXOR(F.col("c.fp")).alias("bits"), F.col("c.met").alias("met"), F.col("c.cls").alias("centre"))
    if "parts" not in classes.columns:
        held = held.mapInPandas(_near_centres, held.schema)
    stars = compacted(checkpointed(held.groupBy("cls").agg(F.max(F.struct("met", "centre")).alias("c")).select(F.col("c.centre").alias("a"), F.col("cls").alias("b"))), 32)
    texts = _texts(active.select(*[c for c in ("cls", "hash") if c in active.columns]), docs)
    links = _stars(stars, texts)
    roots = components(links)
    placed = members.join(roots.withColumnRenamed("node", "cls"), "cls", "left").select("key", "cls", F.coalesce("component", "cls").alias("root"))
    # blocks whose members are all joined need no second look
    unjoined = placed.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).filter("lo <> hi").select("key")
    rest = placed.join(unjoined, "key")
    if "parts" in classes.columns:
        rest = compacted(checkpointed(rest), 32)
        some = block_pairs(rest, "key", F.xxhash64("cls"), 8 * BLOCK).join(active.select("cls", "parts"), "cls")
        some = some.repartition("key", "block_i", "block_j").sortWithinPartitions("key", "block_i", "block_j")

        def run_parts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            yield from stream(batches, ["key", "block_i", "block_j"], SMALL, partial(_with_partners, likely=likely, width=width))

        some = some.select("key", "block_i", "block_j", "own", "cls", "root", "parts").mapInPandas(run_parts, "key long, cls long")
        rest = rest.join(compacted(checkpointed(some.distinct()), 32), ["key", "cls"])
    rest = compacted(checkpointed(rest.join(active.select("cls", "n"), "cls")), 40)
    blocks = block_pairs(rest, "key", F.xxhash64("cls"), BLOCK, 1 + F.floor(F.col("n") / 256)).join(active.select("cls", "fp", "keys"), "cls").join(texts, "cls")
    blocks = blocks.repartition("key", "block_i", "block_j").sortWithinPartitions("key", "block_i", "block_j")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        yield from stream(batches, ["key", "block_i", "block_j"], SMALL, _links)
        release_memory()

    more = blocks.select("key", "block_i", "block_j", "own", "cls", "root", "n", "fp", "keys", "text").mapInPandas(run, "a long, b long")
    return components(links.unionByName(checkpointed(more)))


def keep_one(docs: DataFrame) -> DataFrame:
    """The rows of `docs` without near copies: of each group, one row with its smallest doc_id.

    A null doc_id is kept only where its group has no other; of rows repeated whole, or with equal id and text,
    one stays. Null and empty texts are copies of each other. All columns come back as they were, whatever
    their names; an empty table gives none. A row that shares its group with no other never enters a join.
    """
    placed = checkpointed(groups(docs))
    first = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_hash")
    kept = checkpointed(placed.groupBy("root").agg(F.min(first).alias("k"), F.count(F.lit(1)).alias("rows")))
    crowd = placed.join(kept.filter("rows > 1").select("root"), "root", "left_semi").select("text_hash")
    rows = flagged(packed(docs, "doc_id", F.xxhash64("text").alias("hash")), "hash", crowd)
    kept = kept.select(F.col("k.doc_id").alias("kept_id"), F.col("k.text_hash").alias("hash"))
    one = rows.filter("maybe").join(kept, "hash").filter(F.col("doc_id").eqNullSafe(F.col("kept_id"))).dropDuplicates(["doc_id", "hash"])
    return unpacked(rows.filter("not maybe").select("row").unionByName(one.select("row")), docs.columns)
