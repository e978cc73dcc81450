"""Connected components over tables of edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..store import checkpointed

#: Edges that a task takes at least, before they are dealt to more.
EDGES = 250_000


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) for every node that has an edge; component is its smallest reachable node.

    Alternates large-star and small-star rounds ("Connected components in MapReduce and beyond") until no
    edge changes, however many that takes (about log2 of the longest chain, squared at most); each round is
    two grouped aggregations, checkpointed, and the driver sees one count. Hubs are safe: a node's neighbours
    are only joined to their minimum, never listed. Loops and null ends are dropped; no edges give no rows.
    A round is cut into tasks of at least `EDGES` edges, so that few edges make no more files than they need.
    """
    whole = int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    e = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).filter("u <> v")
    e = checkpointed(e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    before, parts = None, -(-e.count() // EDGES) or 1
    while True:
        few = lambda df, k=parts: df.coalesce(k) if 4 * k <= whole else df
        e = few(e)
        both = e.unionAll(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.filter("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v")
        large = few(large).distinct()
        down = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (
            large.join(down, "u")
            .select(F.explode(F.array(F.struct(F.col("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("x"))
            .select("x.u", "x.v")
            .filter("u <> v")
        )
        e = checkpointed(few(small).distinct())
        now = tuple(e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == before:
            break
        before, parts = now, -(-now[0] // EDGES) or 1
    e = few(e)
    stars = e.groupBy("u").agg(F.min("v").alias("component"))
    return stars.select(F.col("u").alias("node"), "component").unionAll(
        e.select(F.col("v").alias("node")).distinct().join(stars.select(F.col("u").alias("node")), "node", "left_anti").select("node", F.col("node").alias("component"))
    )
