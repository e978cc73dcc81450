"""Embedding near-duplicates by cross-polytope hashing.

A vector is padded to a power of two and turned by three rounds of random signs and a fast Hadamard
transform; its hash is the axis, with sign, that it then lies closest to. A table joins `FACTORS` such
hashes into a bucket key; each vector is stored under its key and probes the keys with the next best
axis in one factor. All pairs that meet are verified by their cosine in double precision.

Equal vectors (by a digest of 128 bits) are one class with a count. Only keys are shuffled at first; buckets
of one class, and those that are probed but store none, are dropped before any vector moves. A pair that
meets in several buckets is counted in the first of them only, which each bucket finds out by itself from the
keys of the pair, so that links are summed in the buckets and never listed; components come from a spanning
forest of each bucket.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .buckets import forest, small_pairs, stream
from .common import block_pairs, checkpointed, components, flagged, table

COSINE, TABLES, FACTORS, SEED = 0.9, 8, 2, 20240517
#: Rows of a block of a large bucket, and up to how many rows a bucket counts as small.
BLOCK, SMALL = 2048, 24


def hadamard(x: np.ndarray) -> np.ndarray:
    """The fast Walsh-Hadamard transform of each row, scaled to keep lengths."""
    n, d = x.shape
    h = 1
    while h < d:
        y = x.reshape(n, d // (2 * h), 2, h)
        x = np.stack([y[:, :, 0] + y[:, :, 1], y[:, :, 0] - y[:, :, 1]], 2).reshape(n, d)
        h *= 2
    return x / np.sqrt(d)


def keys_of(x: np.ndarray, tables: int = TABLES, factors: int = FACTORS) -> np.ndarray:
    """Bucket keys, shape (rows, tables, 1 + factors): the own key, then one probe for each factor."""
    n, d = x.shape
    width = 1 << max(1, (d - 1).bit_length())
    x = np.concatenate([x, np.zeros((n, width - d))], 1)
    rng = np.random.default_rng([SEED, d])
    out = np.zeros((n, tables, 1 + factors), np.int64)
    for t in range(tables):
        own, step = np.full(n, d, np.int64), []
        for _ in range(factors):
            y = x
            for _ in range(3):
                y = hadamard(y * rng.choice([-1.0, 1.0], width))
            best = np.argpartition(-np.abs(y), 1, axis=1)[:, :2]
            size = np.take_along_axis(np.abs(y), best, 1)
            best = np.where((size[:, :1] >= size[:, 1:]), best, best[:, ::-1])
            axis = best * 2 + (np.take_along_axis(y, best, 1) > 0)
            own = own * (2 * width) + axis[:, 0]
            step = [s * (2 * width) for s in step] + [axis[:, 1] - axis[:, 0]]
        out[:, t, 0] = own * tables + t
        for k, s in enumerate(step):
            out[:, t, 1 + k] = (own + s) * tables + t
    return out


def _first_meeting(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The bucket in which a pair with keys a, b (pairs, tables, 1 + factors) is counted: the least key of the first table where they meet."""
    none = np.iinfo(np.int64).max
    out = np.full(len(a), none)
    for t in range(a.shape[1] - 1, -1, -1):
        at_a = np.where((b[:, t] == a[:, t, :1]).any(1), a[:, t, 0], none)
        at_b = np.where((a[:, t] == b[:, t, :1]).any(1), b[:, t, 0], none)
        here = np.minimum(at_a, at_b)
        out = np.where(here < none, here, out)
    return out


def _compare(rows: pd.DataFrame, group: np.ndarray, large: bool, cosine: float, tables: int, factors: int) -> pd.DataFrame | None:
    """Per vector class of a bucket: rows of other classes linked to it that are counted here, and a root it links to."""
    raw = rows["vec"].tolist()
    base, key, count, cls = rows["base"].to_numpy(), rows["key"].to_numpy(), rows["n"].to_numpy(), rows["cls"].to_numpy()
    dims = np.fromiter(map(len, raw), np.int64, len(raw))
    found_i, found_j = [], []
    # the dimension is part of every key, so a group has one
    unit = np.zeros((len(raw), dims.max()))
    for d in np.unique(dims):
        x = np.array([v for v, k in zip(raw, dims, strict=True) if k == d], dtype=np.float64)
        x /= np.abs(x).max(1, keepdims=True)
        unit[dims == d, :d] = x / np.sqrt((x * x).sum(1, keepdims=True))
    if large:
        bi, bj = rows["block_i"].iloc[0], rows["block_j"].iloc[0]
        own = rows["own"].to_numpy()
        left, right = np.flatnonzero(own == bi), np.flatnonzero(own == bj)
        for at in range(0, len(left), 256):
            some = left[at : at + 256]
            i, j = np.nonzero(unit[some] @ unit[right].T >= cosine)
            i, j = some[i], right[j]
            ok = (i < j) if bi == bj else (i != j)
            found_i.append(i[ok])
            found_j.append(j[ok])
    else:
        i, j = small_pairs(group)
        ok = np.flatnonzero(base[i] | base[j])
        for at in range(0, len(ok), 1 << 16):
            k = ok[at : at + (1 << 16)]
            k = k[np.einsum("ij,ij->i", unit[i[k]], unit[j[k]]) >= cosine]
            found_i.append(i[k])
            found_j.append(j[k])
    if not found_i:
        return None
    i, j = np.concatenate(found_i), np.concatenate(found_j)
    ok = (base[i] | base[j]) & (cls[i] != cls[j])
    i, j = i[ok], j[ok]
    if not len(i):
        return None
    sums = np.zeros(len(raw), np.int64)
    for d in np.unique(dims):
        used = np.unique(np.concatenate([i, j]))
        used = used[dims[used] == d]
        at = np.full(len(raw), -1)
        at[used] = np.arange(len(used))
        keys = keys_of(unit[used][:, :d], tables, factors)
        for s in range(0, len(i), 1 << 16):
            a, b = i[s : s + (1 << 16)], j[s : s + (1 << 16)]
            own_d = dims[a] == d
            a, b = a[own_d], b[own_d]
            here = _first_meeting(keys[at[a]], keys[at[b]]) == key[a]
            np.add.at(sums, a[here], count[b[here]])
            np.add.at(sums, b[here], count[a[here]])
    root = forest(len(raw), i, j)
    own = np.flatnonzero((sums > 0) | (root != np.arange(len(raw))))
    return pd.DataFrame({"cls": cls[own], "linked": sums[own], "root": cls[root[own]]})


def usable(vec: Column) -> Column:
    """True for a vector with a direction: not null or zero, every component there and finite."""
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    return F.coalesce(~F.exists(vec, bad) & F.exists(vec, lambda x: x != 0), F.lit(False))


def near_duplicates(
    vectors: DataFrame, ident: str = "vec_id", vector: str = "embedding", cosine: float = COSINE, tables: int = TABLES, factors: int = FACTORS, block: int = BLOCK
) -> DataFrame:
    """One row per row of `vectors`: vec_id, n_links, component_id, kept.

    Vectors without a direction (null, empty or zero, or with null or non-finite components) link with nothing and
    are their own component; so are rows with a null id, whose component_id is the least known id of their
    group. Vectors of different length never link. Rows with the same id are rows of their own, each with its
    own links; equal vectors link with each other. Other columns are not read; an empty table gives none.
    """
    rows = vectors.select(F.col(ident).alias("vec_id"), F.col(vector).alias("vec")).withColumn("ok", usable(F.col("vec")))
    rows = rows.withColumns({"h1": F.xxhash64("vec"), "h2": F.xxhash64(F.lit(SEED), "vec")})
    classes = rows.filter("ok").groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n"), F.min("vec_id").alias("least"), F.first("vec").alias("vec"))
    # the checkpoint fixes the numbers of the classes
    classes = checkpointed(classes.withColumn("cls", F.monotonically_increasing_id()))

    def hashed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            raw = batch["vec"].tolist()
            dims = np.fromiter(map(len, raw), np.int64, len(raw))
            for d in np.unique(dims):
                own = np.flatnonzero(dims == d)
                x = np.array([raw[k] for k in own], dtype=np.float64)
                x /= np.abs(x).max(1, keepdims=True)
                unit = x / np.sqrt((x * x).sum(1, keepdims=True))
                keys = keys_of(unit, tables, factors)
                width = keys.shape[2]
                at = np.repeat(own, tables * width)
                yield pd.DataFrame({"cls": batch["cls"].to_numpy()[at], "key": keys.ravel(), "base": np.tile(np.arange(width) == 0, len(own) * tables)})

    keyed = checkpointed(classes.select("cls", "vec").mapInPandas(hashed, "cls long, key long, base boolean"))
    shared = checkpointed(keyed.groupBy("key").agg(F.count(F.lit(1)).alias("k"), F.max("base").alias("stored")).filter("k > 1 and stored").select("key"))
    meeting = flagged(keyed, "key", shared).filter("maybe").select("cls", "key", "base").join(shared, "key", "left_semi")
    dealt = block_pairs(checkpointed(meeting), "key", F.xxhash64("cls", "base"), block).join(classes.select("cls", "n", "vec"), "cls")
    dealt = dealt.repartition("key", "block_i", "block_j").sortWithinPartitions("key", "block_i", "block_j")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        yield from stream(batches, ["key", "block_i", "block_j"], SMALL, lambda r, g, large: _compare(r, g, large, cosine, tables, factors))

    met = dealt.select("key", "block_i", "block_j", "own", "cls", "n", "base", "vec").mapInPandas(run, "cls long, linked long, root long")
    met = checkpointed(met)
    sums = met.groupBy("cls").agg(F.sum("linked").alias("linked"))
    roots = components(met.filter("cls <> root"), "cls", "root")
    placed = classes.join(sums, "cls", "left").join(roots, classes["cls"] == roots["node"], "left")
    placed = placed.select("h1", "h2", "least", (F.col("n") - 1 + F.coalesce("linked", F.lit(0))).alias("n_links"), F.coalesce("component", "cls").alias("root"))
    least = placed.groupBy("root").agg(F.min("least").alias("component_id"))
    placed = placed.join(least, "root").select("h1", "h2", "n_links", "component_id")
    linked = rows.filter("ok").select("vec_id", "h1", "h2").join(placed, ["h1", "h2"]).select("vec_id", "n_links", "component_id")
    alone = rows.filter("not ok").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))


def op8_embeddings(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "embeddings"))
