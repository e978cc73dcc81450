"""Conversation prefix trie by van Emde Boas recursion.

Conversations are sequences of turns; each distinct beginning of one is a node. Depth is cut in halves, as in
the layout of van Emde Boas, all subproblems of a level at once:

1. Down in size: blocks of 1, 2, 4, ... turns get names, each a digest of the names of its two halves.
2. Up in depth: the sequence of the first d turns is named by the largest cut below d and the block that follows
   it. With the cuts of a level named, the upper tries and the lower forests below them are built side by side in
   the next level, so all beginnings have names after about log2 of the longest sequence levels.
3. Totals are grafted upward by the same halves: what a node has goes half the height up to its ancestor there,
   is added up by node, and both go on with half the height.

No sequence is ever in one row, and no node gathers its members: turns are numbered by a range sort with carried
counts, nodes are sums that tasks begin before they shuffle, and the ids that end in a node are joined to pieces
where they lie in order, which a task then reads one after the other.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpointed, table

#: Ids in a piece of a list of ids, and bits of the row number within a partition (as Spark counts them).
PIECE, ROW_BITS = 4096, 33
#: The contract's rebuilding: conversations of a block share turns of the first, up to `SHARED` - 1 of them.
CONVERSATIONS, SHARED = 5, 9


def _digest(data: Column) -> Column:
    return F.substring(F.unhex(F.sha2(data, 256)), 1, 16)


def numbered(conversations: DataFrame) -> DataFrame:
    """(conv_id, i, name, bytes): turns numbered from 1 in the order of (turn, role, text), nulls first; name is a digest of role and text.

    Rows are sorted by range, and each range adds the counts of the ranges before it, so a conversation of any length is spread.
    """
    text = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("role", "text")]
    order = ["conv_id", "turn", "role", "text"]
    rows = conversations.filter("conv_id is not null").select("conv_id", "turn", *text).repartitionByRange(*order).sortWithinPartitions(*order)
    name = _digest(F.concat(F.encode(F.concat(F.octet_length("role").cast("string"), F.lit(":"), "role"), "utf-8"), F.encode("text", "utf-8")))
    rows = checkpointed(rows.select(F.col("conv_id").cast("long").alias("conv_id"), name.alias("name"), F.octet_length("text").cast("long").alias("bytes"), F.monotonically_increasing_id().alias("at")))
    rows = rows.withColumn("range", F.shiftright("at", ROW_BITS))
    runs = rows.groupBy("conv_id", "range").agg(F.min("at").alias("low"), F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(Window.partitionBy("conv_id").orderBy("range").rowsBetween(Window.unboundedPreceding, -1))
    runs = runs.withColumn("before", F.coalesce(before, F.lit(0)))
    return rows.join(runs, ["conv_id", "range"]).select("conv_id", (F.col("at") - F.col("low") + F.col("before") + 1).alias("i"), "name", "bytes")


def rebuilt(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The conversations (conv_id, turns) and their turns (conv_id, d, name, bytes) after the first turns of each block's first
    conversation took the place of as many of their own."""
    own = turns.groupBy("conv_id").agg(F.count(F.lit(1)).alias("own"))
    convs = own.withColumn("h", F.crc32(F.col("conv_id").cast("string").cast("binary")) % SHARED).withColumn("first", F.col("conv_id") - F.col("conv_id") % CONVERSATIONS)
    convs = convs.join(own.select(F.col("conv_id").alias("first"), F.col("own").alias("theirs")), "first", "left")
    convs = convs.withColumn("taken", F.least("h", F.coalesce("theirs", F.lit(0))))
    convs = checkpointed(convs.withColumn("turns", F.col("taken") + F.greatest(F.col("own") - F.col("h"), F.lit(0))))
    kept = turns.join(convs.select("conv_id", "h", "taken"), "conv_id").filter("i > h").select("conv_id", (F.col("taken") + F.col("i") - F.col("h")).alias("d"), "name", "bytes")
    taken = turns.filter(F.col("i") < SHARED).withColumnRenamed("conv_id", "first").join(convs.select("conv_id", "first", "h"), "first").filter("i <= h")
    return convs.select("conv_id", "turns"), kept.unionByName(taken.select("conv_id", F.col("i").alias("d"), "name", "bytes"))


def prefixes(convs: DataFrame, turns: DataFrame, longest: int) -> DataFrame:
    """(conv_id, d, name) for every d from 0 to the length of each conversation; equal names at equal depth are equal beginnings."""
    blocks, size = [turns.select("conv_id", (F.col("d") - 1).alias("q"), "name")], 1
    while 2 * size <= longest:
        half = F.shiftright("q", 1).alias("q")
        left, right = (blocks[-1].filter(F.col("q") % 2 == k).select("conv_id", half, F.col("name").alias(n)) for k, n in ((0, "a"), (1, "b")))
        blocks.append(checkpointed(left.join(right, ["conv_id", "q"]).select("conv_id", "q", _digest(F.concat("a", "b")).alias("name"))))
        size *= 2
    found = convs.select("conv_id", F.lit(0).cast("long").alias("d"), F.lit(b"").alias("name"))
    for block in reversed(blocks):
        # cuts of this level: the block after a named beginning that ends where the block begins
        after = block.filter("q % 2 = 0").select("conv_id", (F.col("q") * size).alias("d"), F.col("name").alias("block"))
        new = after.join(found, ["conv_id", "d"]).select("conv_id", (F.col("d") + size).alias("d"), _digest(F.concat("name", "block")).alias("name"))
        found = found.unionByName(checkpointed(new))
        size //= 2
    return found


def _hashed_ids(ends: DataFrame) -> DataFrame:
    """(d, name, ends_sha256) from rows (d, name, conv_id): the digest of the node's ids in ascending order, joined by commas."""
    node = ["d", "name"]

    def pieces(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if not len(batch):
                continue
            d, name, ids = (batch[c].to_numpy() for c in ("d", "name", "conv_id"))
            cuts = np.flatnonzero((d[1:] != d[:-1]) | (name[1:] != name[:-1])) + 1
            bounds = np.unique(np.concatenate([[0], cuts, np.arange(0, len(ids), PIECE), [len(ids)]]))
            out = [(d[a], name[a], ids[a], ",".join(map(str, ids[a:b].tolist()))) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
            yield pd.DataFrame(out, columns=["d", "name", "first", "ids"])

    def digests(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, sha = None, None
        for batch in batches:
            out = []
            for d, name, ids in zip(batch["d"], batch["name"], batch["ids"], strict=True):
                if key == (d, name):
                    sha.update(b",")
                else:
                    if key:
                        out.append((*key, sha.hexdigest()))
                    key, sha = (d, name), hashlib.sha256()
                sha.update(ids.encode())
            yield pd.DataFrame(out, columns=["d", "name", "ends_sha256"])
        if key:
            yield pd.DataFrame([(*key, sha.hexdigest())], columns=["d", "name", "ends_sha256"])

    order = [*node, "conv_id"]
    parts = ends.select(*order).repartitionByRange(*order).sortWithinPartitions(*order).mapInPandas(pieces, "d long, name binary, first long, ids string")
    return parts.repartition(*node).sortWithinPartitions(*node, "first").mapInPandas(digests, "d long, name binary, ends_sha256 string")


def prefix_trie(convs: DataFrame, turns: DataFrame) -> DataFrame:
    """The trie of conversations (conv_id, turns: how many) with their turns (conv_id, d from 1, name, bytes): a row for each node.

    conv_id (smallest member) and depth are the node's key; parent_conv_id (null for the root), n_convs, n_children,
    n_leaves and saved_tokens (of the subtree), ends_sha256. Without a conversation there is no node, not even the root.
    """
    node = ["d", "name"]
    longest = int(turns.agg(F.max("d")).first()[0] or 0)
    found = checkpointed(prefixes(convs, turns, longest))
    own = found.filter("d > 0").groupBy(*node).agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs"))
    own = own.join(turns.select("conv_id", "d", "bytes"), ["conv_id", "d"])
    parents = found.select("conv_id", (F.col("d") + 1).alias("d"), F.col("name").alias("parent"))
    root = convs.agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs")).filter("n_convs > 0")
    root = root.select("conv_id", F.lit(0).cast("long").alias("d"), F.lit(b"").alias("name"), "n_convs", F.lit(0).cast("long").alias("bytes"), F.lit(None).cast("binary").alias("parent"))
    nodes = checkpointed(own.join(parents, ["conv_id", "d"]).select(*root.columns).unionByName(root))
    children = nodes.filter("d > 0").groupBy((F.col("d") - 1).alias("d"), F.col("parent").alias("name")).agg(F.count(F.lit(1)).alias("n_children"))
    nodes = checkpointed(nodes.join(children, node, "left").fillna(0, ["n_children"]))

    # n_leaves and saved_tokens of a node go to itself and to all its ancestors, by halves of the height
    sums = nodes.select("conv_id", *node, (F.col("n_children") == 0).cast("long").alias("n_leaves"), ((F.col("n_convs") - 1) * F.col("bytes")).alias("saved_tokens"))
    height = 1 << longest.bit_length()
    while height > 1:
        height //= 2
        up = sums.drop("name").withColumn("d", F.explode(F.array("d", F.col("d") - height))).filter("d >= 0")
        sums = up.join(found, ["conv_id", "d"]).groupBy(*node).agg(F.min("conv_id").alias("conv_id"), F.sum("n_leaves").alias("n_leaves"), F.sum("saved_tokens").alias("saved_tokens"))

    ends = _hashed_ids(convs.select("conv_id", F.col("turns").alias("d")).join(found, ["conv_id", "d"]))
    above = nodes.select((F.col("d") + 1).alias("d"), F.col("name").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    out = nodes.join(sums.drop("conv_id"), node).join(ends, node, "left").join(above, ["d", "parent"], "left")
    none = hashlib.sha256().hexdigest()
    return out.select("conv_id", F.col("d").alias("depth"), "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(none)).alias("ends_sha256"))


def rebuilt_trie(conversations: DataFrame) -> DataFrame:
    """The trie of `conversations` (conv_id, turn, role, text) after `rebuilt`.

    Null roles and texts are empty; a null turn comes first; turns that tie are ordered by role and text, repeated rows
    are turns of their own. Rows without a conv_id belong to no conversation and are no turns. Other columns are not read;
    an empty table gives none.
    """
    convs, turns = rebuilt(checkpointed(numbered(conversations)))
    return prefix_trie(convs, checkpointed(turns))


def op13_prefixes(spark, sf_dir: str) -> DataFrame:
    return rebuilt_trie(table(spark, sf_dir, "conversations"))


SQL = r"""
with t as (select conv_id, coalesce(role, '') as role, coalesce(text, '') as text, row_number() over (partition by conv_id order by turn nulls first, role nulls first, text nulls first) as i from conversations where conv_id is not null),
o as (select conv_id, list({'r': role, 't': text} order by i) as a from t group by 1),
h as (select *, xor(4294967295, list_reduce(list_prepend(4294967295::bigint, list_transform(string_split(conv_id::varchar, ''), lambda x: ascii(x)::bigint)),
  lambda c, x: list_reduce(list_prepend(xor(c, x), range(8)), lambda s, k: case when s & 1 = 1 then xor(s >> 1, 3988292384) else s >> 1 end))) % 9 as h from o),
c as (select h.conv_id, list_concat(coalesce(b.a[1:h.h], []), h.a[h.h + 1:]) as a from h left join o b on b.conv_id = h.conv_id - h.conv_id % 5),
m as (select conv_id, a, d, a[1:d] as p from (select conv_id, a, unnest(range(len(a) + 1)) as d from c) x),
n as (select d, p, min(conv_id) as conv_id, count(*) as n_convs, string_agg(conv_id::varchar, ',' order by conv_id) filter (len(a) = d) as ends from m group by 1, 2),
k as (select *, case when d > 0 then (n_convs - 1) * strlen(p[d].t) else 0 end as saved, (select count(*) from n x where x.d = n.d + 1 and x.p[1:n.d] = n.p) as n_children from n)
select v.conv_id, v.d::bigint as depth, (select x.conv_id from k x where v.d > 0 and x.d = v.d - 1 and x.p = v.p[1:v.d - 1]) as parent_conv_id, v.n_convs, v.n_children,
  (select count(*) from k u where u.d >= v.d and u.p[1:v.d] = v.p and u.n_children = 0) as n_leaves,
  cast((select sum(u.saved) from k u where u.d >= v.d and u.p[1:v.d] = v.p) as bigint) as saved_tokens, sha256(coalesce(v.ends, '')) as ends_sha256 from k v"""
