"""Mixing overlapping sources to target weights by min-cost flow.

Documents are aggregated by membership pattern (the set of sources they belong to). A flow network
routes each pattern's word capacity to the quotas of its sources: every pattern has one arc for each
repetition of its words, and the arcs get dearer with each repetition, so a second copy of anything is
used only where no first copy will do. What a pattern sends is then turned into documents: in the order
of a seeded hash, up to the amount sent, found from a histogram of the hash so that no source is ever
sorted as a whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACE, checkpointed, table

WEIGHTS, REPEATS, SEED = (5, 2, 1), 3, 17
#: Most (pattern, source) pairs that the driver solves for; beyond it the mix has to be cut by pattern first.
MAX_ARCS = 200_000
#: Bins of the seeded hash in a pattern.
BINS = 4096
#: Single documents added to a pattern at the end, to come nearer to its target.
PICKS = 3


def size_of(text: Column) -> Column:
    """Number of runs of other than ASCII white space; 0 for null."""
    return F.coalesce(F.size(F.regexp_extract_all(text, F.lit(f"[^{SPACE}]+"), F.lit(0))), F.lit(0)).cast("long")


def targets(sizes: list[tuple[object, int]], weights: tuple[float, ...] = WEIGHTS, repeats: float = REPEATS) -> dict[object, float]:
    """Word targets of the sources, given in order with their sizes.

    The total of all sizes is shared by the repeating weights; a share above `repeats` times its source
    stops there, and the excess is shared again by weight until none is above.
    """
    weight = {s: weights[k % len(weights)] for k, (s, _) in enumerate(sizes)}
    cap = {s: repeats * n for s, n in sizes}
    left, free, out = float(sum(n for _, n in sizes)), [s for s, _ in sizes], {}
    while free:
        total = sum(weight[s] for s in free)
        over = [s for s in free if left * weight[s] / total > cap[s]]
        if not over:
            return out | {s: left * weight[s] / total for s in free}
        out |= {s: float(cap[s]) for s in over}
        left -= sum(cap[s] for s in over)
        free = [s for s in free if s not in out]
    return out


def route(patterns: dict[tuple, int], quotas: dict[object, float], repeats: int = REPEATS) -> dict[tuple, dict[object, float]]:
    """Words that each pattern (tuple of sources) sends to each of its sources; min-cost flow.

    The network is start -> pattern -> source -> sink. A pattern has `repeats` arcs from the start, each as wide
    as its words; the r-th costs 2 r - 1 a word, so total cost is the sum of squares of repetitions. All other
    arcs are free, so the cheapest augmenting paths are those that begin with the cheapest arc left: arcs are
    opened level by level, and each level is augmented until no path is left, straight ones first, then, breadth
    first, those that move what other patterns send to a source that they share.
    """
    sent = {p: dict.fromkeys(p, 0.0) for p in patterns}
    need = dict(quotas)
    members: dict[object, list[tuple]] = {}
    for p in patterns:
        for s in p:
            members.setdefault(s, []).append(p)
    tiny = 1e-6 * max(1.0, sum(quotas.values()))
    room = dict.fromkeys(patterns, 0.0)

    def send(p: tuple, path: list[tuple[tuple, object]], goal: object) -> None:
        """Augments from pattern `p`; `path` lists (pattern, source that its words leave) in order from the goal."""
        amount = min([need[goal], room[p], *(sent[q][s] for q, s in path)])
        need[goal] -= amount
        room[p] -= amount
        for q, s in path:
            sent[q][goal] += amount
            sent[q][s] -= amount
            goal = s
        sent[p][goal] += amount

    for _ in range(repeats):
        for p, n in patterns.items():
            room[p] += n
            for s in p:
                if room[p] > 0 and need[s] > 0:
                    send(p, [], s)
        while True:
            back: dict = {p: None for p in patterns if room[p] > tiny}
            queue, found = list(back), None
            for p in queue:
                found = next(((p, s) for s in p if need[s] > tiny), None)
                if found:
                    break
                for s in p:
                    for q in members[s]:
                        if q not in back and sent[q][s] > tiny * 1e-3:
                            back[q] = p, s
                            queue.append(q)
            if not found:
                break
            p, goal = found
            path = []
            while back[p]:
                before, s = back[p]
                path.append((p, s))
                p = before
            send(p, path, goal)
    return sent


def mix(docs: DataFrame, sources: Column, weights: tuple[float, ...] = WEIGHTS, repeats: int = REPEATS, seed: int = SEED) -> DataFrame:
    """`docs` with a struct `_out` (size, source_size, target, taken, copies) for the mix of its `sources`.

    `sources` is an array of source names; a null name is a source of its own that sorts last, and
    source_size and target are sums over a document's sources. taken = copies x size, and copies is at most
    `repeats`. A document of size 0 (null and empty texts) has no copies; a null id is an id, and repeated rows get
    the same copies. Same rows, same seed: same mix, in any partitioning. Columns come back as they were,
    whatever their names, but for `_out`, which is replaced. An empty table gives none.
    """
    rows = docs.select(F.struct("*").alias("row"), F.col("doc_id").alias("_d"), size_of(F.col("text")).alias("_n"), F.xxhash64("text").alias("_t"), F.array_sort(F.array_distinct(sources)).alias("_p"))
    # nulls sort last in array_sort; a hash of what the row is orders documents, repeated rows stay together
    rows = rows.withColumn("_h", F.xxhash64(F.lit(seed), "_d", "_t")).withColumn("_bin", F.pmod(F.col("_h"), F.lit(BINS)))
    keyed = checkpointed(rows.select("_p", "_bin", "_h", "_d", "_n"))
    bins = checkpointed(keyed.groupBy("_p", "_bin").agg(F.sum("_n").alias("words")))
    per_pattern = bins.groupBy("_p").agg(F.sum("words").alias("words"))
    arcs = per_pattern.agg(F.sum(F.size("_p"))).first()[0] or 0
    if arcs > MAX_ARCS:
        raise ValueError(f"{arcs} (pattern, source) pairs; at most {MAX_ARCS} are solved at once")
    patterns = {tuple(r["_p"]): int(r["words"]) for r in per_pattern.collect()}
    sizes: dict[object, int] = {}
    for p, n in patterns.items():
        for s in p:
            sizes[s] = sizes.get(s, 0) + n
    ordered = sorted(sizes.items(), key=lambda x: (x[0] is None, (x[0] or "").encode("utf-8", "surrogatepass")))
    quota = targets(ordered, weights, repeats)
    sent = route(patterns, quota, repeats)
    plan = []
    for p, n in patterns.items():
        amount = sum(sent[p].values())
        full = min(repeats, int((amount + 1e-6) // n)) if n else 0
        plan.append((list(p), full, float(amount - full * n) if full < repeats else 0.0, int(sum(sizes[s] for s in p)), float(sum(quota[s] for s in p))))
    spark = docs.sparkSession
    plan = spark.createDataFrame(plan, "_p array<string>, full int, rest double, source_size long, target double")

    # the bin in which a pattern's rest ends, and the words in the bins before it
    upto = F.sum("words").over(Window.partitionBy("_p").orderBy("_bin").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    ends = bins.withColumn("upto", upto).join(plan.select("_p", "rest"), "_p").filter("upto > rest and upto - words <= rest")
    ends = ends.select("_p", F.col("_bin").alias("end_bin"), (F.col("upto") - F.col("words")).alias("before"), "rest")
    border = keyed.join(F.broadcast(ends), "_p").filter("_bin = end_bin")
    order = Window.partitionBy("_p").orderBy("_h", "_d", "_n")
    border = border.withColumn("cum", F.col("before") + F.sum("_n").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    # the last document that still fits, by its hash
    cut = border.groupBy("_p").agg(F.max(F.when(F.col("cum") <= F.col("rest"), F.col("_h"))).alias("end_h"), F.min(F.when(F.col("cum") > F.col("rest"), F.col("_h"))).alias("over_h"))
    ends = ends.join(cut, "_p", "left")
    plan = plan.join(ends.select("_p", "end_bin", "end_h", "over_h"), "_p", "left")
    inside = (F.col("_bin") < F.col("end_bin")) | ((F.col("_bin") == F.col("end_bin")) & (F.col("_h") <= F.col("end_h")) & ((F.col("_h") < F.col("over_h")) | F.col("over_h").isNull()))
    inside = F.coalesce(inside, F.lit(False))
    plan = checkpointed(plan)
    state = keyed.filter("_n > 0").join(F.broadcast(plan.filter("end_bin is not null")), "_p")
    state = state.select("_p", "_h", "_d", "_n", "full", "rest", (F.col("full") + inside.cast("int")).alias("_c"))
    picks = None
    for _ in range(PICKS):  # one more copy of the document that comes nearest to what is left
        short = state.groupBy("_p").agg((F.first("rest") - F.sum((F.col("_c") - F.col("full")) * F.col("_n"))).alias("short"))
        best = state.join(F.broadcast(short), "_p").filter((F.col("_c") < repeats) & (F.abs(F.col("_n") - F.col("short")) < F.col("short")))
        best = best.groupBy("_p").agg(F.max(F.struct(-F.abs(F.col("_n") - F.col("short")), "_c", "_h", "_d")).alias("x"))
        best = checkpointed(best.select("_p", F.col("x._h").alias("_eh"), F.col("x._d").alias("_ed")))
        picks = best if picks is None else picks.unionByName(best)
        chosen = (F.col("_h") == F.col("_eh")) & F.col("_d").eqNullSafe(F.col("_ed"))
        state = state.join(F.broadcast(best), "_p", "left").withColumn("_c", F.col("_c") + F.coalesce(chosen, F.lit(False)).cast("int")).drop("_eh", "_ed")
    picks = picks.groupBy("_p").agg(F.collect_list(F.struct("_eh", "_ed")).alias("picks"))
    plan = checkpointed(plan.join(picks, "_p", "left"))
    out = rows.join(F.broadcast(plan.withColumnRenamed("_p", "_q")), F.col("_p") == F.col("_q"))
    extra = F.size(F.filter(F.coalesce("picks", F.array()), lambda x: (x["_eh"] == F.col("_h")) & x["_ed"].eqNullSafe(F.col("_d"))))
    copies = F.when(F.col("_n") > 0, F.col("full") + inside.cast("int") + extra).otherwise(0).cast("int")
    fields = F.struct(F.col("_n").alias("size"), "source_size", "target", (copies * F.col("_n")).cast("long").alias("taken"), copies.alias("copies"))
    return out.select(*[F.col("row").getField(c).alias(c) for c in docs.columns if c != "_out"], fields.alias("_out"))


def op10_mixing(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return mix(docs, F.array("source")).select("doc_id", "_out.*")
