"""Source divergence audit with duplicate-text collapse.

Identical texts of a language are one text with a multiplicity for each source. Each such text is cut into
terms once; its counts, and its document frequency, are weighted by the multiplicities and added up in the
task before anything moves. Terms that enough documents of the language hold are kept; a group (language,
source) then gives each kept term a smoothed share in billionths, all in whole numbers.

1. Digests of the texts are counted by language and source; no text moves for that. A text that occurs once is
   cut where it lies; only texts that occur again (behind a Bloom filter) are shuffled, so that one copy of each stays.
2. The counts of a term lie side by side, one entry for each source that has it. Pairs of sources are evaluated from
   those entries: the distance of two sources is V |p0a - p0b|, as if no term occurred in either, corrected for each
   term that occurs in one of them. A task adds these corrections up for `BLOCK` x `BLOCK` sources at most.
3. The groups, of which the result lists every pair within a language, are the only rows that reach the driver.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpointed, flagged, table, written

#: Least documents of a language with a kept term, added to every count, the shares' unit, and the ranks of part `term`.
LEAST, SMOOTH, UNIT, TOP = 30, 5, 1_000_000_000, 50
#: Distinct (group, term) pairs that a task holds before it passes them on.
HELD = 400_000
#: Sources on a side of the square whose distances a task adds up, and terms that are evaluated at a time.
BLOCK, TERMS = 512, 512
#: Letters A-Z become small, other ASCII becomes a blank, and bytes of longer code points stay.
_TERM = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def terms_of(text: str) -> list[bytes]:
    """Runs of letters A-Z, a-z and of code points beyond ASCII; only A-Z are lower-cased."""
    return text.encode("utf-8", "replace").translate(_TERM).split()


def collapsed(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The groups (lang, source, docs), and one row per language and distinct text: lang, text, sources (source and copies)."""
    rows = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")])
    rows = rows.withColumn("digest", F.unhex(F.sha2("text", 256))).withColumn("key", F.xxhash64("lang", "digest"))
    copies = checkpointed(rows.groupBy("key", "lang", "digest", "source").agg(F.count(F.lit(1)).alias("n")))
    groups = copies.groupBy("lang", "source").agg(F.sum("n").alias("docs"))
    texts = copies.groupBy("key", "lang", "digest").agg(F.sum("n").alias("n"), F.collect_list(F.struct("source", "n")).alias("sources"))
    again = checkpointed(texts.filter("n > 1"))
    marked = flagged(rows, "key", again.select("key"))
    once = marked.filter("not maybe").select("lang", "text", F.array(F.struct("source", F.lit(1).cast("long").alias("n"))).alias("sources"))
    # the filter lets other texts through as well: they are found again by their own multiplicities
    maybe = marked.filter("maybe").groupBy("key", "lang", "digest").agg(F.first("text").alias("text"), F.first("source").alias("source"))
    more = maybe.join(again.drop("n"), ["key", "lang", "digest"], "left")
    more = more.select("lang", "text", F.coalesce("sources", F.array(F.struct("source", F.lit(1).cast("long").alias("n")))).alias("sources"))
    return groups, once.unionByName(more)


def term_counts(texts: DataFrame) -> DataFrame:
    """(lang, source, term, n, df): occurrences and documents of each term in each group, from the rows of `collapsed`."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n: dict[tuple[str, str], Counter] = defaultdict(Counter)
        df: dict[tuple[str, str], Counter] = defaultdict(Counter)

        def passed() -> Iterator[pd.DataFrame]:
            for group in list(n):
                own, docs = n.pop(group), df.pop(group)
                terms = list(own)
                if not terms:
                    continue
                yield pd.DataFrame({"lang": group[0], "source": group[1], "term": [t.decode() for t in terms], "n": [own[t] for t in terms], "df": [docs[t] for t in terms]})

        for batch in batches:
            for lang, text, sources in zip(batch["lang"], batch["text"], batch["sources"], strict=True):
                found = terms_of(text)
                distinct = set(found)
                for s in sources:
                    group, times = (lang, s["source"]), int(s["n"])
                    if times == 1:
                        n[group].update(found)
                        df[group].update(distinct)
                    else:
                        own, docs = n[group], df[group]
                        for t, k in Counter(found).items():
                            own[t] += k * times
                            docs[t] += times
            if sum(map(len, df.values())) > HELD:
                yield from passed()
        yield from passed()

    return texts.mapInPandas(run, "lang string, source string, term string, n long, df long")


def _share(n: str, total: str, kept: str) -> F.Column:
    """1 + floor(UNIT (n + SMOOTH) / (total + SMOOTH kept)) in whole numbers of up to 38 digits."""
    return F.expr(f"1 + (cast({UNIT} as decimal(20, 0)) * cast({n} + {SMOOTH} as decimal(18, 0))) div cast({total} + {SMOOTH} * {kept} as decimal(20, 0))")


def _corrections(p0: np.ndarray, term: np.ndarray, source: np.ndarray, p: np.ndarray, many: int, left: slice, right: slice) -> np.ndarray:
    """Of the terms of some rows: for sources a in `left`, b in `right`, the sum of |pa - pb| - |p0a - p0b| over the terms
    of a, and where b has the term too only if a < b, so that (a, b) and (b, a) add up to all terms of either."""
    out = np.zeros((left.stop - left.start, right.stop - right.start), np.int64)
    base = p0[right]
    dense, has = np.tile(base, (many, 1)), np.zeros((many, len(base)), bool)
    own = (source >= right.start) & (source < right.stop)
    dense[term[own], source[own] - right.start] = p[own]
    has[term[own], source[own] - right.start] = True
    order = np.argsort(source, kind="stable")
    term, source, p = term[order], source[order], p[order]
    ends = np.searchsorted(source, np.arange(left.start, left.stop + 1))
    later = np.arange(right.start, right.stop)
    for a in range(left.start, left.stop):
        at = slice(ends[a - left.start], ends[a - left.start + 1])
        if at.start < at.stop:
            rows = term[at]
            d = np.abs(dense[rows] - p[at, None]) - np.abs(base - p0[a])
            out[a - left.start] = np.where(has[rows] & (later < a), 0, d).sum(0)
    return out


def _pairs(spark, entries: DataFrame, sources: dict[str, tuple[list[str], np.ndarray]]) -> DataFrame:
    """(lang, a, b, value): the summed corrections of `_corrections` for numbered sources, from rows (lang, e: source number and p)."""
    shared = spark.sparkContext.broadcast({k: v[1] for k, v in sources.items()})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[tuple, np.ndarray] = {}
        for batch in batches:
            for (lang, bi, bj), rows in batch.groupby(["lang", "bi", "bj"], sort=False):
                p0 = shared.value[lang]
                left, right = (slice(b * BLOCK, min(len(p0), (b + 1) * BLOCK)) for b in (bi, bj))
                for at in range(0, len(rows), TERMS):
                    part = rows["e"].iloc[at : at + TERMS].tolist()
                    term = np.repeat(np.arange(len(part)), [len(e) for e in part])
                    source = np.array([x["s"] for e in part for x in e], np.int64)
                    p = np.array([x["p"] for e in part for x in e], np.int64)
                    got = _corrections(p0, term, source, p, len(part), left, right)
                    key = lang, bi, bj
                    sums[key] = sums[key] + got if key in sums else got
            if sum(x.size for x in sums.values()) > 4 * BLOCK * BLOCK:
                yield from passed(sums)
        yield from passed(sums)

    def passed(sums: dict) -> Iterator[pd.DataFrame]:
        for lang, bi, bj in list(sums):
            m = sums.pop((lang, bi, bj))
            a, b = np.nonzero(m)
            yield pd.DataFrame({"lang": lang, "a": a + bi * BLOCK, "b": b + bj * BLOCK, "value": m[a, b]})

    blocks = F.sequence(F.lit(0), F.floor((F.col("sources") - 1) / BLOCK).cast("int"))
    dealt = entries.withColumn("bi", F.explode(blocks)).withColumn("bj", F.explode(blocks)).select("lang", "bi", "bj", "e")
    return dealt.mapInPandas(run, "lang string, a long, b long, value long").groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))


def source_divergence(docs: DataFrame, least: int = LEAST, top: int = TOP) -> DataFrame:
    """How the sources of each language differ in their terms: lang, source, part, item, value, rank.

    `docs` has text, lang and source; nulls count as empty strings, which are a language or source like any other.
    Part `pair` has a row for each other source of the language, part `term` the `top` terms that the group uses
    more than its language. Repeated rows each count. Ties are ranked by the bytes of the item. A group without
    kept terms has its pairs (value 0 if its language keeps none) and no terms; other columns are not read; an
    empty table gives none. Whole numbers throughout; 18 digits are the most that a count may have.
    """
    spark = docs.sparkSession
    groups, texts = collapsed(docs)
    counts = term_counts(texts).repartition("lang", "term").groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("df").alias("df"))
    terms = counts.groupBy("lang", "term").agg(F.sum("n").alias("n"), F.sum("df").alias("df"), F.collect_list(F.struct("source", "n")).alias("e"))
    terms = written(terms.filter(F.col("df") >= least).drop("df"))
    flat = terms.select("lang", F.explode("e").alias("e")).groupBy("lang", F.col("e.source").alias("source")).agg(F.sum("e.n").alias("total"))
    kept = terms.groupBy("lang").agg(F.count(F.lit(1)).alias("kept"), F.sum("n").alias("lang_total"))
    groups = groups.select("lang", "source").join(flat, ["lang", "source"], "left").join(kept, "lang", "left").fillna(0)
    groups = groups.withColumn("p0", F.when(F.col("kept") > 0, _share("0L", "total", "kept")).otherwise(0))
    groups = checkpointed(groups.withColumn("s", F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1).withColumn("sources", F.count(F.lit(1)).over(Window.partitionBy("lang"))))

    own = terms.select("lang", "term", F.col("n").alias("lang_n"), F.explode("e").alias("e")).select("lang", "term", "lang_n", "e.source", "e.n")
    own = own.join(F.broadcast(groups), ["lang", "source"]).withColumn("p", _share("n", "total", "kept"))  # of which every pair is a row of the result
    q = _share("lang_n", "lang_total", "kept")
    by_group = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    words = own.select("lang", "source", F.col("term").alias("item"), (F.col("p") - q).alias("value")).filter("value > 0").withColumn("rank", F.row_number().over(by_group)).filter(F.col("rank") <= top)

    sides: dict[str, tuple[list[str], np.ndarray]] = {}
    for lang, rows in groups.select("lang", "source", "s", "p0").toPandas().sort_values("s").groupby("lang"):
        sides[lang] = rows["source"].tolist(), rows["p0"].to_numpy(np.int64)
    entries = own.groupBy("lang", "term").agg(F.collect_list(F.struct("s", "p")).alias("e"), F.first("sources").alias("sources"))
    part = _pairs(spark, entries, sides)
    both = part.unionAll(part.select("lang", F.col("b").alias("a"), F.col("a").alias("b"), "value")).groupBy("lang", "a", "b").agg(F.sum("value").alias("more"))
    mine, other = groups.select("lang", "source", "s", "p0", "kept"), groups.select("lang", F.col("source").alias("item"), F.col("s").alias("b"), F.col("p0").alias("q0"))
    pairs = mine.join(other, "lang").filter("s <> b").join(both.withColumnRenamed("a", "s"), ["lang", "s", "b"], "left")
    value = F.abs(F.col("p0") - F.col("q0")) * F.col("kept") + F.coalesce("more", F.lit(0))
    pairs = pairs.select("lang", "source", "item", value.alias("value")).withColumn("rank", F.row_number().over(by_group))
    out = pairs.withColumn("part", F.lit("pair")).unionByName(words.withColumn("part", F.lit("term")))
    return out.select("lang", "source", "part", "item", "value", F.col("rank").cast("int").alias("rank"))


def op12_sources(spark, sf_dir: str) -> DataFrame:
    return source_divergence(table(spark, sf_dir, "documents"))


SQL = r"""
with d as (select coalesce(text, '') as text, coalesce(lang, '') as lang, coalesce(source, '') as source, row_number() over () as i from documents),
w as (select lang, source, i, translate(unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as term from d),
kept as (select lang, term, count(*) as lang_n from w group by 1, 2 having count(distinct i) >= 30),
c as (select lang, source, term, count(*) as n from w semi join kept using (lang, term) group by 1, 2, 3),
g as (select lang, source from d group by 1, 2),
v as (select lang, count(*) as v, sum(lang_n) as lang_total from kept group by 1),
t as (select g.lang, g.source, coalesce(sum(n), 0) as total from g left join c using (lang, source) group by 1, 2),
p as (select t.lang, t.source, k.term, coalesce(n, 0) as n, 1 + 1000000000::hugeint * (coalesce(n, 0) + 5) // (total + 5 * v)::hugeint as p, 1 + 1000000000::hugeint * (lang_n + 5) // (lang_total + 5 * v)::hugeint as q
  from t join kept k using (lang) join v using (lang) left join c on c.lang = t.lang and c.source = t.source and c.term = k.term),
pairs as (select a.lang, a.source, b.source as item, coalesce(sum(abs(x.p - y.p)), 0) as value from g a join g b on a.lang = b.lang and a.source <> b.source
  left join p x on x.lang = a.lang and x.source = a.source left join p y on y.lang = b.lang and y.source = b.source and y.term = x.term group by 1, 2, 3),
r as (select lang, source, 'pair' as part, item, value, row_number() over (partition by lang, source order by value desc, item) as rank from pairs
  union all select lang, source, 'term', term, p - q, row_number() over (partition by lang, source order by p - q desc, term) from p where n > 0 and p > q)
select lang, source, part, item, cast(value as bigint) as value, cast(rank as int) as rank from r where part = 'pair' or rank <= 50"""
