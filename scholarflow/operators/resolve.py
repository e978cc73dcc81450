"""Entity resolution and similarity joins over vectors."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from heapq import merge

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..store import checkpointed
from .components import components


#: Queries of a task that are held against its items at a time.
SLICE = 64


def pairs_within(concepts: DataFrame, block: int = 256) -> DataFrame:
    """(a, b, score) of all pairs a < b of concepts of one name and brand: 1.0 if their difficulty is the same, else 0.7.

    The result has all pairs of equal rows, which is quadratic. A group is cut into parts of about `block` concepts, each kept as one list;
    every concept meets the lists of its own and of later parts, so that a large group is dealt to many tasks and hardly a row is formed that is not returned.
    """
    key = ["name", "brand"]
    rows = concepts.select(F.col("concept_id").alias("a"), *key, "difficulty")
    sizes = rows.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    dealt = rows.join(sizes.select(*key, F.ceil(F.col("n") / block).cast("int").alias("parts")), key)
    dealt = dealt.withColumn("own", F.pmod(F.xxhash64("a"), F.col("parts")).cast("int"))
    lists = dealt.groupBy(*key, F.col("own").alias("part")).agg(F.collect_list(F.struct(F.col("a").alias("b"), F.col("difficulty").alias("d2"))).alias("others"))
    met = dealt.withColumn("part", F.explode(F.sequence("own", F.col("parts") - 1))).join(lists, [*key, "part"])
    pairs = met.select("a", "difficulty", (F.col("own") < F.col("part")).alias("apart"), F.inline("others")).filter("apart or a < b")
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), F.when(F.col("difficulty") == F.col("d2"), 1.0).otherwise(0.7).alias("score"))


def topk_similar(queries: DataFrame, items: DataFrame, k: int = 20, block: int = 4096) -> DataFrame:
    """The `k` most similar items of each query by cosine, exactly.

    Queries (a stated set, a block of them per task) meet the items block by block: each pair of blocks is one
    task that multiplies two matrices, `SLICE` queries at a time, and keeps k rows per query, so what is shuffled is k rows per query
    and block of items, not the pairs.
    """
    n_items = max(1, items.count())
    blocks = -(-n_items // block)
    i = items.select(F.col("id").alias("item"), "vec", F.pmod(F.xxhash64("id"), F.lit(blocks)).alias("ib"), F.lit(False).alias("is_query"))
    nq = max(1, queries.count())
    qblocks = -(-nq // block)
    q = queries.select(F.col("id").alias("item"), "vec", F.pmod(F.xxhash64("id"), F.lit(qblocks)).alias("qb"), F.lit(True).alias("is_query"))
    left = q.withColumn("ib", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))))
    right = i.withColumn("qb", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(qblocks - 1).cast("long"))))

    def meet(rows: pd.DataFrame) -> pd.DataFrame:
        a, b = rows[rows["is_query"]], rows[~rows["is_query"]]
        if a.empty or b.empty:
            return pd.DataFrame({"query": [], "item": [], "cos": []})
        unit = lambda d: (lambda x: x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300))(np.array(d["vec"].tolist(), dtype=np.float64))
        b = b.sort_values("item", kind="stable")
        x, y, items, queries = unit(a), unit(b).T, b["item"].to_numpy(), a["item"].to_numpy()
        out = []
        for at in range(0, len(x), SLICE):
            cos = np.round(x[at : at + SLICE] @ y, 9)
            # items are in order, so a stable sort leaves ties to the lesser one
            keep = np.argsort(-cos, axis=1, kind="stable")[:, : k + 1]
            rows_ = np.repeat(np.arange(len(cos)), keep.shape[1])
            out.append(pd.DataFrame({"query": queries[at + rows_], "item": items[keep.ravel()], "cos": cos[rows_, keep.ravel()]}))
        return pd.concat(out)

    met = left.unionByName(right).groupBy("qb", "ib").applyInPandas(meet, "query long, item long, cos double").filter("query <> item")
    order = Window.partitionBy("query").orderBy(F.desc("cos"), "item")
    return met.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def _tie(a, b):
    """What decides between pairs of clusters of equal average; Spark and numpy compute it alike."""
    return (a % 1_000_003 * 7_919 + b % 1_000_003 * 104_729) % 1_000_033


def _linked(rows: pd.DataFrame, threshold: float) -> pd.DataFrame:
    """(old, new) of the clusters of one component (a, b, total, na, nb) that the best merges, one after the other, join to a lesser one."""
    ids = np.unique(rows[["a", "b"]].to_numpy())
    i, j = np.searchsorted(ids, rows["a"]), np.searchsorted(ids, rows["b"])
    total, size, root = np.zeros((len(ids), len(ids))), np.ones(len(ids), np.int64), np.arange(len(ids))
    total[i, j] = total[j, i] = rows["total"]
    size[i], size[j] = rows["na"], rows["nb"]
    tie = _tie(np.minimum(ids[:, None], ids), np.maximum(ids[:, None], ids))
    mean = np.round(total / np.outer(size, size), 12)
    np.fill_diagonal(mean, -1)
    while len(ids) > 1 and (best := mean.max()) >= threshold - 1e-12:
        at = np.flatnonzero(mean == best)
        x, y = sorted(divmod(int(at[tie.ravel()[at].argmax()]), len(ids)))
        total[x] += total[y]
        total[:, x] = total[x]
        size[x] += size[y]
        mean[x] = mean[:, x] = np.where(mean[x] < 0, -1, np.round(total[x] / (size[x] * size), 12))
        mean[y] = mean[:, y] = mean[x, x] = -1
        root[root == y] = x
    gone = root != np.arange(len(ids))
    return pd.DataFrame({"old": ids[gone], "new": ids[root[gone]]})


def clusters(pairs: DataFrame, threshold: float = 0.8, in_task: int = 2000, sizes: DataFrame | None = None) -> DataFrame:
    """Average-linkage clusters (node, cluster: its smallest node) from scored pairs (a, b, score); unscored pairs count 0.

    A merge needs one pair at the threshold or above, so components of those pairs bound every cluster, and only pairs within
    one are looked at. A component of up to `in_task` clusters is merged in one task. In larger ones each round on Spark merges all pairs of
    clusters that are each other's nearest neighbour at an average of `threshold` or more: a merge never brings a third cluster nearer
    to either, so the order among them doesn't matter and the result is that of merging the best pair each time. Pairs of clusters carry
    the sum of their scores (the update of Lance and Williams for averages), which is added up where clusters were joined, until no
    more can be or few enough are left. Ties are broken by `_tie`, so that many equal pairs merge in one round. Nodes without a partner
    in their component have no row; of repeated pairs the highest score counts, loops and null ends don't.
    A node may stand for many that are alike: `sizes` (node, n) then says for how many, 1 if it has no row. They score 1 with each other and alike with all others,
    so they are one cluster to begin with, and their pairs are never listed.
    """
    pairs = pairs.filter("a <> b").groupBy(F.least("a", "b").cast("long").alias("a"), F.greatest("a", "b").cast("long").alias("b")).agg(F.max("score").alias("score"))
    of = components(pairs.filter(F.col("score") >= threshold).select("a", "b"))
    inside = pairs.join(of.select(F.col("node").alias("a"), F.col("component").alias("part")), "a").join(of.select(F.col("node").alias("b"), F.col("component").alias("cb")), "b").filter("part = cb")
    one = F.lit(1).cast("long")
    links = inside.select("part", "a", "b", F.col("score").cast("double").alias("total"), one.alias("na"), one.alias("nb"))
    for end in "ab" if sizes is not None else "":
        links = links.join(sizes.select(F.col("node").alias(end), F.col("n").cast("long").alias("n")), end, "left").withColumn(f"n{end}", F.coalesce("n", one)).drop("n")
    links = checkpointed(links.select("part", "a", "b", (F.col("total") * F.col("na") * F.col("nb")).alias("total"), "na", "nb"))
    nodes = checkpointed(links.select("part", F.explode(F.array("a", "b")).alias("node")).distinct().select("node", F.col("node").alias("cluster"), "part"))

    def joined(nodes: DataFrame, merged: DataFrame) -> DataFrame:
        return checkpointed(nodes.join(merged.select(F.col("old").alias("cluster"), "new"), "cluster", "left").select("node", F.coalesce("new", "cluster").alias("cluster"), "part"))

    while True:
        large = nodes.select("part", "cluster").distinct().groupBy("part").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > in_task).select("part")
        now = checkpointed(links.join(large, "part", "left_semi"))
        mean = F.round(F.col("total") / (F.col("na") * F.col("nb")), 12)
        near = now.withColumn("mean", mean).filter("mean > 0").withColumn("tie", _tie(F.col("a"), F.col("b")))
        best = near.select(F.explode(F.array("a", "b")).alias("c"), F.struct("mean", "tie", "a", "b", "na", "nb").alias("x")).groupBy("c").agg(F.max("x").alias("x"))
        # a pair that is the best of both its ends
        merged = best.filter(F.col("x.mean") >= threshold - 1e-12).groupBy("x").agg(F.count(F.lit(1)).alias("ends")).filter("ends = 2")
        merged = checkpointed(merged.select(F.explode(F.array("x.a", "x.b")).alias("old"), F.col("x.a").alias("new"), (F.col("x.na") + F.col("x.nb")).alias("n")))
        if not merged.head(1):
            break
        for end in "ab":
            to = merged.select(F.col("old").alias(end), F.col("new").alias(f"new_{end}"), F.col("n").alias(f"n_{end}"))
            links = links.join(to, end, "left").withColumn(end, F.coalesce(f"new_{end}", end)).withColumn(f"n{end}", F.coalesce(f"n_{end}", f"n{end}")).drop(f"new_{end}", f"n_{end}")
        swap = F.col("a") > F.col("b")
        turned = [F.when(swap, F.col(y)).otherwise(F.col(x)).alias(x) for x, y in (("a", "b"), ("b", "a"), ("na", "nb"), ("nb", "na"))]
        links = checkpointed(links.filter("a <> b").select("part", *turned, "total").groupBy("part", "a", "b").agg(F.sum("total").alias("total"), F.first("na").alias("na"), F.first("nb").alias("nb")))
        nodes = joined(nodes, merged)
    # what is large still can't be merged any more
    rest = links.join(now.select("part").distinct(), "part", "left_anti")
    merged = rest.groupBy("part").applyInPandas(lambda rows: _linked(rows, threshold), "old long, new long")
    return joined(nodes, merged).select("node", "cluster")


def class_clusters(members: DataFrame, pairs: DataFrame, threshold: float = 0.8) -> DataFrame:
    """`clusters` of the members (cls, node) of classes from the scored pairs (a, b, score) of classes alone; members of a class score 1 with each other.

    A class is known by a number, and a cluster by its smallest node. Nodes that are alone have no row.
    """
    sizes = members.groupBy("cls").agg(F.count(F.lit(1)).alias("n"), F.min("node").alias("least"))
    placed = checkpointed(sizes.join(clusters(pairs, threshold, sizes=sizes.select(F.col("cls").alias("node"), "n")).withColumnRenamed("node", "cls"), "cls", "left").withColumn("cluster", F.coalesce("cluster", "cls")))
    whole = placed.groupBy("cluster").agg(F.sum("n").alias("all"), F.min("least").alias("first")).filter(F.col("all") > 1)
    return members.join(placed.select("cls", "cluster").join(whole, "cluster").select("cls", "first"), "cls").select("node", F.col("first").alias("cluster"))


def class_resolve(members: DataFrame, pairs: DataFrame, threshold: float = 0.8) -> DataFrame:
    """`resolve` of each member (cls, node) to the best of all lesser ones, from the scored pairs of classes alone; members of a class score 1 with each other.

    Of a class that scores alike with a member its smallest node is taken, if that is the lesser one; so each member meets classes, not their members.
    """
    least = members.groupBy("cls").agg(F.min("node").alias("existing_id"))
    own = least.select("cls", "existing_id", F.lit(1.0).alias("score"))
    good = pairs.filter((F.col("score") >= threshold) & (F.col("a") != F.col("b")))
    both = good.select("a", "b", "score").unionByName(good.select(F.col("b").alias("a"), F.col("a").alias("b"), "score"))
    others = both.join(least.withColumnRenamed("cls", "b"), "b").select(F.col("a").alias("cls"), "existing_id", "score")
    met = members.join(own.unionByName(others).filter(F.col("score") >= threshold), "cls").filter("existing_id < node")
    return resolve(met.select(F.col("node").alias("new_id"), "existing_id", "score"), threshold)


def resolve(scored: DataFrame, threshold: float = 0.8) -> DataFrame:
    """Mapping of new concepts to the existing one with the best score at the threshold or above: (new_id, existing_id, score)."""
    best = scored.filter(F.col("score") >= threshold).groupBy("new_id").agg(F.max_by(F.struct("existing_id", "score"), F.struct("score", -F.col("existing_id"))).alias("x"))
    return best.select("new_id", "x.*")


def _walk(candidates: Iterable[tuple[float, int, float]], budget: float) -> list[tuple[int, int, float]]:
    """(pos, concept, hours before) of the concepts taken from (-gain, concept, hours) in this order, until 80 % of the budget are used."""
    used, out = 0.0, []
    for _, concept, hours in candidates:
        if used >= 0.8 * budget:
            break
        if used + hours <= budget:
            out.append((len(out), concept, used))
            used += hours
    return out


def greedy_paths(mastery: DataFrame, concepts: DataFrame, budget: float, light: int = 200) -> DataFrame:
    """Repeated choice of the concept with most to gain until 80 % of the hours are used, for each learner.

    mastery: (learner_id, concept_id, level), the highest level of a pair counts and a null one is 0; unseen concepts
    are at 0. Ties go to the lesser id. Concepts without a time or a difficulty, or longer than the budget, are
    never taken. Of the concepts of equal length at most n = budget / length fit, always the first ones, so
    that the first n + k of each length are enough for a learner who knows k: this list does not grow with
    the concepts. It is broadcast for learners who know up to `light` concepts (at most 60 x budget lengths with
    60 x budget + light + 1 rows each); the others join it by length.
    """
    most = int(60 * budget) + 1
    worth = 1 - F.abs(F.col("difficulty") / 5.0 - 0.5)
    c = concepts.select(F.col("concept_id").cast("long").alias("concept_id"), F.col("time_estimate").cast("int").alias("minutes"), worth.alias("worth")).filter(F.col("minutes").between(1, most - 1) & (F.col("worth") > 0))
    fits = F.floor(F.lit(60 * budget) / F.col("minutes")) + 1
    levels = mastery.groupBy("learner_id", F.col("concept_id").cast("long").alias("concept_id")).agg(F.coalesce(F.max("level"), F.lit(0.0)).alias("level"))
    known = levels.join(c, "concept_id", "left")
    sizes = checkpointed(known.groupBy("learner_id").agg(F.count("minutes").alias("n")))
    largest = sizes.agg(F.max("n")).first()[0] or 0

    def ranked(n: int) -> DataFrame:
        by_length = Window.partitionBy("minutes").orderBy(F.desc("worth"), "concept_id")
        return c.withColumn("r", F.row_number().over(by_length)).filter(F.col("r") <= most + n)

    shared = ranked(light).filter(F.col("r") <= fits + light).select("worth", "concept_id", "minutes").toPandas()
    order = mastery.sparkSession.sparkContext.broadcast(sorted((-w, k, m / 60) for w, k, m in zip(*(shared[x].tolist() for x in shared.columns), strict=True)))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for learner, rows in zip(batch["learner_id"], batch["known"], strict=True):
                seen = {r["concept_id"] for r in rows}
                own = sorted(((r["level"] - 1) * r["worth"], r["concept_id"], r["minutes"] / 60) for r in rows if r["level"] < 0.9)
                out += [(learner, *step) for step in _walk(merge((x for x in order.value if x[1] not in seen), own), budget)]
            yield pd.DataFrame(out, columns=["learner_id", "pos", "concept_id", "hours_before"])

    schema = "learner_id long, pos int, concept_id long, hours_before double"
    few = known.join(sizes.filter(F.col("n") <= light).select("learner_id"), "learner_id", "left_semi")
    entry = F.when(F.col("minutes").isNotNull(), F.struct("concept_id", "level", "minutes", "worth"))
    paths = few.groupBy("learner_id").agg(F.collect_list(entry).alias("known")).mapInPandas(run, schema)
    if largest <= light:
        return paths

    many = sizes.filter(F.col("n") > light).select("learner_id")
    held = known.filter("minutes is not null").join(many, "learner_id", "left_semi")
    lengths = F.broadcast(c.agg(F.collect_set("minutes").alias("lengths")))  # one row
    wants = many.join(lengths).select("learner_id", F.explode("lengths").alias("minutes")).join(held.groupBy("learner_id", "minutes").agg(F.count(F.lit(1)).alias("k")), ["learner_id", "minutes"], "left")
    near = wants.join(ranked(largest), "minutes").filter(F.col("r") <= fits + F.coalesce("k", F.lit(0)))
    unseen = near.select("learner_id", "concept_id", "minutes", F.col("worth").alias("gain")).join(held.select("learner_id", "concept_id"), ["learner_id", "concept_id"], "left_anti")
    gains = unseen.unionByName(held.filter("level < 0.9").select("learner_id", "concept_id", "minutes", ((1 - F.col("level")) * F.col("worth")).alias("gain")))
    best = Window.partitionBy("learner_id", "minutes").orderBy(F.desc("gain"), "concept_id")
    first = gains.withColumn("r", F.row_number().over(best)).filter(F.col("r") <= most).filter(F.col("r") <= fits)

    def choose(rows: pd.DataFrame) -> pd.DataFrame:
        order = sorted((-g, k, m / 60) for g, k, m in zip(rows["gain"].tolist(), rows["concept_id"].tolist(), rows["minutes"].tolist(), strict=True))
        return pd.DataFrame([(rows["learner_id"].iloc[0], *step) for step in _walk(order, budget)], columns=["learner_id", "pos", "concept_id", "hours_before"])

    return paths.unionByName(first.groupBy("learner_id").applyInPandas(choose, schema))
