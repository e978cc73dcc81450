"""SimHash near-duplicates with bit-sliced comparison.

Fingerprints are stored as vertical bit planes: word w of plane b holds bit b of 64 fingerprints. One
pass over the planes updates the distances of a whole block at once, two planes at a time, with a
carry-save full adder into two counter bits and a sticky overflow bit; a block is abandoned as soon as
every distance in it exceeds the radius, and columns of 64 that do are dropped on the way.

Candidates are exact: of the radius + 2 parts of a fingerprint, two must agree between fingerprints
that differ in at most `radius` bits, so each pair of parts is a bucket key. Only distinct fingerprints
are compared, and each task reports a spanning forest of the links it finds, never all pairs.

`near_duplicates` links by fingerprints alone; `keep_one` (in `near_copies`) takes five-word shingles and a
similarity of 0.8, for which the planes only choose the pairs whose shingle sets are compared.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .buckets import forest, small_pairs, stream
from .common import block_pairs, checkpointed, components, table, with_columns_from
from .near_copies import keep_one  # noqa: F401
from .planes import BITS, planes_of, within

SEED, SHINGLE, RADIUS = 42, 3, 2
#: Rows of a block of a large bucket, and up to how many rows a bucket counts as small.
BLOCK, SMALL = 4096, 48


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """The 64-bit SimHash of a text as a signed integer; 0 if it is null or has no word.

    Words are runs of other than ASCII white space, A-Z lower-cased; a text of fewer words than a
    shingle is one shingle. A bit is 1 if it is set in over half the shingles, repeats included.
    """
    words = (text or "").encode("utf-8", "replace").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    k = min(shingle, len(words))
    starts = np.concatenate([[0], ends[: len(words) - k] + 1]).tolist()
    of = xxhash.xxh64_intdigest
    h = np.fromiter([of(joined[a:b], SEED) for a, b in zip(starts, ends[k - 1 :].tolist(), strict=True)], np.uint64, len(starts))
    counts = np.zeros(BITS, np.int64)
    for at in range(0, len(h), 1 << 16):
        counts += np.unpackbits(h[at : at + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(h), bitorder="little").view(np.int64)[0])


def fingerprints(docs: DataFrame, text: str = "text") -> DataFrame:
    """`docs` with a struct `_out` (fingerprint)."""
    return with_columns_from(docs, text, T.StructType([T.StructField("fingerprint", T.LongType())]), lambda: lambda values: [(fingerprint(v),) for v in values])


def _links(rows: pd.DataFrame, group: np.ndarray, large: bool, radius: int = RADIUS) -> pd.DataFrame | None:
    """A spanning forest (a, b) of the links between the rows of small groups, or between the blocks of a large one."""
    x = rows["fp"].to_numpy()
    if large:
        bi, bj = rows["block_i"].iloc[0], rows["block_j"].iloc[0]
        left, right = (np.flatnonzero(rows["own"].to_numpy() == b) for b in (bi, bj))
        planes = planes_of(x[right])
        found = []
        for at in range(0, len(left), 64):
            q, c = within(planes, x[left[at : at + 64]], radius)
            keep = c < len(right)
            found.append((left[at + q[keep]], right[c[keep]]))
        i, j = (np.concatenate(z) for z in zip(*found, strict=True)) if found else (np.zeros(0, int), np.zeros(0, int))
    else:
        i, j = small_pairs(group)
        if not len(i):
            return None
        near = []
        for at in range(0, len(i), 1 << 17):
            # the planes of the differences, against a query of zero
            _, c = within(planes_of(x[i[at : at + (1 << 17)]] ^ x[j[at : at + (1 << 17)]]), np.zeros(1, np.uint64), radius)
            near.append(c[c < min(1 << 17, len(i) - at)] + at)
        near = np.concatenate(near)
        i, j = i[near], j[near]
    root = forest(len(x), i, j)
    own = np.flatnonzero(root != np.arange(len(x)))
    return pd.DataFrame({"a": x[own], "b": x[root[own]]}) if len(own) else None


def links(distinct: DataFrame, radius: int = RADIUS, block: int = BLOCK) -> DataFrame:
    """Edges (a, b) that join all distinct fingerprints (column fp) within `radius` bits of each other."""
    parts = radius + 2
    cuts = [BITS * k // parts for k in range(parts + 1)]
    part = [F.shiftrightunsigned("fp", cuts[k]).bitwiseAND(F.lit((1 << cuts[k + 1] - cuts[k]) - 1)) for k in range(parts)]
    keys = F.array(*[F.xxhash64(F.lit(f"{i},{j}"), part[i], part[j]) for i, j in combinations(range(parts), 2)])
    dealt = block_pairs(distinct.select("fp", F.explode(keys).alias("key")), "key", F.xxhash64("fp"), block)
    dealt = dealt.repartition("key", "block_i", "block_j").sortWithinPartitions("key", "block_i", "block_j")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        yield from stream(batches, ["key", "block_i", "block_j"], SMALL, partial(_links, radius=radius))

    return dealt.select("key", "block_i", "block_j", "own", "fp").mapInPandas(run, "a long, b long").distinct()


def groups(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Rows of `docs` (doc_id, text) as doc_id, text_hash, fp, root (the same for a group) and component_id."""
    prints = fingerprints(docs.select("doc_id", "text"))
    prints = checkpointed(prints.select("doc_id", F.xxhash64("text").alias("text_hash"), F.col("_out.fingerprint").alias("fp")))
    classes = checkpointed(prints.groupBy("fp").agg(F.min("doc_id").alias("least")))
    roots = components(links(classes.select("fp"), radius))
    placed = classes.join(roots, classes["fp"] == roots["node"], "left").select("fp", "least", F.coalesce("component", "fp").alias("root"))
    least = placed.groupBy("root").agg(F.min("least").alias("component_id"))
    return prints.join(placed.join(least, "root").select("fp", "root", "component_id"), "fp")


def near_duplicates(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """One row per row of `docs` (doc_id, text): doc_id, fingerprint (16 hex digits), component_id.

    component_id is the smallest doc_id that links reach; null only if no id of the group is known. Null and
    empty texts, and texts without a word, have fingerprint zero and are linked like any other; equal rows
    come back as often as they are there. Other columns are not read; an empty table gives none.
    """
    return groups(docs, radius).select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op9_simhash(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
