"""Removal of repeated passages with a distributed difference-cover suffix sort.

A passage of `LENGTH` bytes that also starts anywhere else is repeated, and every byte of it goes. Beside that,
bytes of shorter repeats, of `PASSAGE` bytes or more (about 50 words), are counted but not removed.

1. Cover. Each start of a `PASSAGE`-byte window belongs to the least hashed 128-byte gram inside the window (the
   leftmost, on ties). Like a difference cover, these places are few, and any two equal windows have one at
   equal offset, so two windows can only be equal if they belong to the same gram. A run of starts with one
   gram is a row: the gram, the document, the place, and a digest of all bytes that its windows cover (its span).
2. Grams that occur once are dropped; nothing that they own can be repeated. Runs with the same gram and
   span get one name, a class; its members are equal suffixes, neighbours in any order.
3. Classes that share a gram are sorted: the spans of one member each are dealt to tasks by gram, bytes that
   no window with a hash met twice covers are cut off, and the suffixes of the rest are ordered by the difference-cover algorithm (`suffix_order`): sort the sampled triples (positions
   1 and 2 modulo 3), recurse on their names until the names are unique or reach past 400 bytes, sort the rest
   by the ranks of their successors, merge, and compare the prefixes of adjacent suffixes. Grams with too many
   classes for one task are compared by grouping digests of their windows, which Spark deals out evenly.
4. Repeated starts are joined back to every member of their class, and the covered bytes are cut out.

All of it is exact up to 128-bit digests. Texts are read twice for the cover. A text is only shuffled if a filter
says that a task may need its bytes: once for the spans of 3, once for the cut of 4.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import checkpointed, flagged, table

LENGTH, PASSAGE, GRAM = 400, 300, 128
#: Starts of one long text that are looked at together; bytes whose suffixes are sorted together.
CHUNK, BATCH = 1 << 21, 2_500_000
#: Classes of a gram up to which one task sorts them.
CLASSES = 4000
_MULTIPLIER = 0x9E3779B97F4A7C15
_BYTE = np.random.default_rng(20240601).integers(0, 2**64, 256, dtype=np.uint64)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


class Anchors:
    """Anchor runs of the windows of texts, with tables of powers that are made once."""

    def __init__(self, length: int = PASSAGE, gram: int = GRAM, chunk: int = CHUNK):
        self.length, self.gram, self.chunk = length, gram, chunk
        self.n = 0

    def _grow(self, n: int) -> None:
        if n > self.n:
            self.n = max(n, min(2 * n, self.chunk + self.length))
            self.up, self.down = _powers(_MULTIPLIER, self.n), _powers(pow(_MULTIPLIER, -1, 2**64), self.n)

    def runs(self, raw: bytes) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """First start, last start, anchor and gram hash of the runs, in order, a chunk at a time."""
        for at in range(0, len(raw) - self.length + 1, self.chunk):
            part = np.frombuffer(raw, np.uint8, min(self.chunk + self.length - 1, len(raw) - at), at)
            lo, hi, a, h = self._runs(part)
            yield lo + at, hi + at, a + at, h

    def _runs(self, x: np.ndarray) -> tuple[np.ndarray, ...]:
        n, k = len(x), self.gram
        width = self.length - k + 1
        self._grow(n)
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(_BYTE[x] * self.up[:n], out=sums[1:])
        h = (sums[k:] - sums[:-k]) * self.down[: n - k + 1]
        h ^= h >> np.uint64(31)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(29)
        # 40 bits of hash and 24 of place: the least is the leftmost of the least
        key = h >> np.uint64(24) << np.uint64(24) | np.arange(len(h), dtype=np.uint64)
        windows = n - self.length + 1
        blocks = np.full(-(-len(h) // width) * width, np.uint64(2**64 - 1))
        blocks[: len(h)] = key
        blocks = blocks.reshape(-1, width)
        before = np.minimum.accumulate(blocks, axis=1).ravel()
        after = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
        own = (np.minimum(after[:windows], before[width - 1 : width - 1 + windows]) & np.uint64((1 << 24) - 1)).astype(np.int64)
        cut = np.flatnonzero(own[1:] != own[:-1]) + 1
        lo, hi = np.concatenate([[0], cut]), np.concatenate([cut - 1, [windows - 1]])
        return lo, hi, own[lo], h[own[lo]].view(np.int64)


KEY = ["gram", "s1", "s2", "shape"]
#: shape packs the bytes of the span, the starts of the run, and how far its anchor is from the first of them.
SPAN_BITS, START_BITS = 40, 20


def _gram_of(passage: int) -> int:
    return min(GRAM, max(1, passage * 3 // 7))


def grams(texts: DataFrame, passage: int = PASSAGE) -> DataFrame:
    """The gram hash of each anchor run of `texts` (text)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        found = Anchors(passage, _gram_of(passage))
        for batch in batches:
            out, size = [], 0
            for text in batch["text"]:
                for _, _, _, h in found.runs(text.encode("utf-8", "replace")):
                    out.append(h)
                    size += len(h)
                if size > 200_000:
                    yield pd.DataFrame({"gram": np.concatenate(out)})
                    out, size = [], 0
            if out:
                yield pd.DataFrame({"gram": np.concatenate(out)})

    return texts.select("text").filter(F.octet_length("text") >= passage).mapInPandas(run, "gram long")


def anchors(texts: DataFrame, length: int = LENGTH, passage: int = PASSAGE) -> DataFrame:
    """The anchor runs of `texts` (d1, d2, text): gram, digest and shape of the span, document, first start."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        found = Anchors(passage, _gram_of(passage))
        digest = xxhash.xxh3_128_digest
        for batch in batches:
            out: list[tuple] = []
            size = 0

            def rows() -> pd.DataFrame:
                gram, spans, shape, d1, d2, start = zip(*out, strict=True)  # noqa: B023
                s = np.frombuffer(b"".join(spans), ">i8").reshape(-1, 2).astype(np.int64)
                n = [len(g) for g in gram]
                return pd.DataFrame({"gram": np.concatenate(gram), "s1": s[:, 0], "s2": s[:, 1], "shape": np.concatenate(shape), "d1": np.repeat(d1, n), "d2": np.repeat(d2, n), "start": np.concatenate(start)})

            for d1, d2, text in zip(batch["d1"], batch["d2"], batch["text"], strict=True):
                raw = text.encode("utf-8", "replace")
                for lo, hi, a, h in found.runs(raw):
                    end = np.minimum(hi + length, len(raw))
                    spans = b"".join([digest(raw[i:j]) for i, j in zip(lo.tolist(), end.tolist(), strict=True)])
                    out.append((h, spans, (end - lo) << SPAN_BITS | (hi - lo + 1) << START_BITS | a - lo, d1, d2, lo))
                    size += len(h)
                if size > 200_000:
                    yield rows()
                    out, size = [], 0
            if out:
                yield rows()

    return texts.filter(F.octet_length("text") >= passage).mapInPandas(run, "gram long, s1 long, s2 long, shape long, d1 long, d2 long, start long")


def suffix_order(x: np.ndarray, need: int) -> np.ndarray:
    """Positions of `x` (values of 1 or more) in the order of their suffixes; only the first `need` symbols count.

    Difference cover modulo 3. Suffixes that agree in `need` symbols are next to each other.
    """
    n = len(x)
    if n < 3:
        return np.array(sorted(range(n), key=lambda i: x[i:].tolist()), np.int64)
    x = np.concatenate([x.astype(np.int64), np.zeros(3, np.int64)])
    base = int(x.max()) + 1
    if base > 2_000_000:  # three symbols must fit into 63 bits
        raise ValueError("too many names for one batch")
    one, two = np.arange(1, n, 3), np.arange(2, n, 3)
    sample = np.concatenate([one, two])
    _, names = np.unique((x[sample] * base + x[sample + 1]) * base + x[sample + 2], return_inverse=True)
    names = names.astype(np.int64) + 1
    if need > 3 and int(names.max()) < len(sample):
        reduced = np.concatenate([names[: len(one)], [1], names[len(one) :] + 1])
        reduced[: len(one)] += 1  # 1 separates the two residues
        order = suffix_order(reduced, -(-need // 3) + 1)
        order = order[order != len(one)]
        order = np.where(order > len(one), order - 1, order)
    else:
        order = np.argsort(names, kind="stable")
    rank = np.zeros(n + 3, np.int64)
    rank[sample[order]] = np.arange(1, len(sample) + 1)
    order = sample[order]
    wide = len(sample) + 1
    zero = np.arange(0, n, 3)
    by_one = lambda i: x[i] * wide + rank[i + 1]
    by_two = lambda i: (x[i] * base + x[i + 1]) * wide + rank[i + 2]
    zero = zero[np.argsort(by_one(zero), kind="stable")]
    firsts, seconds = order[order % 3 == 1], order[order % 3 == 2]
    # suffixes that agree in `need` symbols may come in any order, and then the counts may step back
    before = [np.maximum.accumulate(np.searchsorted(by(own), by(zero))) for by, own in ((by_one, firsts), (by_two, seconds))]
    place = np.arange(len(zero)) + before[0] + before[1]
    out = np.empty(n, np.int64)
    rest = np.ones(n, bool)
    rest[place] = False
    out[place] = zero
    out[rest] = order
    return out


_tables = [np.ones(1, np.uint64)] * 2


def _can_repeat(spans: list[bytes], starts: list[int], lengths: set[int]) -> list[tuple[int, int, int]]:
    """(span, from, to) of the spans that hold windows whose rolling hash occurs twice, without the bytes that no such window covers."""
    global _tables
    raw = np.frombuffer(b"".join(spans), np.uint8)
    if len(raw) >= len(_tables[0]):
        _tables = [_powers(base, 2 * len(raw)) for base in (_MULTIPLIER, pow(_MULTIPLIER, -1, 2**64))]
    up, down = _tables
    sizes = np.array([len(s) for s in spans])
    first = np.cumsum(sizes) - sizes
    sums = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(_BYTE[raw] * up[: len(raw)], out=sums[1:])
    lo, hi = np.full(len(spans), np.iinfo(np.int64).max), np.zeros(len(spans), np.int64)
    for n in lengths:
        fits = np.minimum(np.array(starts), np.maximum(0, sizes - n + 1))
        of = np.repeat(np.arange(len(spans)), fits)
        at = np.arange(len(of)) - np.repeat(np.cumsum(fits) - fits, fits)
        pos = first[of] + at
        h = (sums[pos + n] - sums[pos]) * down[pos]
        order = np.argsort(h)
        equal = h[order[1:]] == h[order[:-1]]
        twice = np.zeros(len(h), bool)
        twice[order[1:][equal]] = twice[order[:-1][equal]] = True
        np.minimum.at(lo, of[twice], at[twice])
        np.maximum.at(hi, of[twice], at[twice] + n)
    return [(int(k), int(lo[k]), int(hi[k])) for k in np.flatnonzero(hi)]


def repeated_starts(spans: list[bytes], starts: list[int], length: int = LENGTH, passage: int = PASSAGE) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """For both lengths, (span, start in it) of all windows among the first `starts` of each span that occur twice in the spans."""
    none = np.zeros(0, np.int64)
    left = _can_repeat(spans, starts, {length, passage})
    if not left:
        return {n: (none, none) for n in {length, passage}}
    names, cut = np.array([k for k, _, _ in left]), np.array([a for _, a, _ in left])
    spans, starts = [spans[k][a:b] for k, a, b in left], [starts[k] - a for k, a, b in left]
    sizes = np.array([len(s) for s in spans])
    text = np.frombuffer(b"".join(s + b"\0" for s in spans), np.uint8).astype(np.int64) + 1
    ends = np.cumsum(sizes + 1)
    text[ends - 1] = 1
    first = ends - sizes - 1
    order = suffix_order(text, length)
    flat = np.concatenate([text.astype(np.uint8) - np.uint8(1), np.zeros(8, np.uint8)])
    words = np.ndarray((len(flat) - 7,), "<u8", flat.data, strides=(1,))
    out = {}
    for n in {length, passage}:
        # the starts whose windows fit into their span
        fits = np.minimum(np.array(starts), np.maximum(0, sizes - n + 1))
        is_start = np.zeros(len(text) + 1, np.int64)
        np.add.at(is_start, first, 1)
        np.add.at(is_start, first + fits, -1)
        own = order[(np.cumsum(is_start)[:-1] > 0)[order]]
        # adjacent prefixes, 8 bytes at a time
        same = np.arange(max(0, len(own) - 1))
        for k in [*range(0, n - 7, 8), n - 8]:
            same = same[words[own[same] + k] == words[own[same + 1] + k]]
        twice = np.unique(np.concatenate([own[same], own[same + 1]]))
        span = np.searchsorted(ends, twice, "right")
        out[n] = names[span], twice - first[span] + cut[span]
    return out


def _as_runs(span: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(span, first, last) of the runs of consecutive starts."""
    cut = np.flatnonzero((span[1:] != span[:-1]) | (start[1:] != start[:-1] + 1)) + 1
    lo, hi = np.concatenate([[0], cut]).astype(int), np.concatenate([cut - 1, [len(span) - 1]]).astype(int)
    return (span[lo], start[lo], start[hi]) if len(span) else (span, start, start)


RUNS = "gram long, s1 long, s2 long, shape long, length int, a long, b long"


def _sorted_within(spans: DataFrame, length: int, passage: int) -> DataFrame:
    """Runs of repeated starts in each class of `spans` (key, span), by sorting the suffixes of each gram."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[tuple] = []  # rows of whole grams, then of the last, which may go on
        size = 0

        def solve(rows: list[tuple]) -> Iterator[pd.DataFrame]:
            starts = [r[3] >> START_BITS & ((1 << SPAN_BITS - START_BITS) - 1) for r in rows]
            for n, (span, start) in repeated_starts([r[4] for r in rows], starts, length, passage).items():
                span, a, b = _as_runs(span, start)
                keys = np.array([r[:4] for r in rows], np.int64).reshape(-1, 4)[span]
                yield pd.DataFrame({**{k: keys[:, i] for i, k in enumerate(KEY)}, "length": n, "a": a, "b": b})

        for batch in batches:
            for row in zip(*(batch[c] for c in KEY), batch["span"], strict=True):
                if size > BATCH // 2 and row[0] != held[-1][0]:
                    yield from solve(held)
                    held, size = [], 0
                held.append(row)
                size += len(row[4]) + 1
        if held:
            yield from solve(held)

    return spans.repartition("gram").sortWithinPartitions("gram").select(*KEY, "span").mapInPandas(run, RUNS)


def _grouped(spans: DataFrame, length: int, passage: int) -> DataFrame:
    """The same for grams with more classes than one task sorts: windows with equal digests, found by grouping."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for n in {length, passage}:
                keys, at, digests, size = [], [], [], 0

                def rows() -> pd.DataFrame:
                    k = np.repeat(np.array(keys, np.int64).reshape(-1, 4), [len(a) for a in at], 0)  # noqa: B023
                    w = np.frombuffer(b"".join(digests), ">i8").reshape(-1, 2).astype(np.int64)  # noqa: B023
                    return pd.DataFrame({**{c: k[:, i] for i, c in enumerate(KEY)}, "length": n, "a": np.concatenate(at), "w1": w[:, 0], "w2": w[:, 1]})  # noqa: B023

                for *key, raw in zip(*(batch[c] for c in KEY), batch["span"], strict=True):
                    starts = min(key[3] >> START_BITS & ((1 << SPAN_BITS - START_BITS) - 1), len(raw) - n + 1)
                    if starts > 0:
                        keys.append(key)
                        at.append(np.arange(starts))
                        digests += [xxhash.xxh3_128_digest(raw[i : i + n]) for i in range(starts)]
                        size += starts
                    if size > 100_000:
                        yield rows()
                        keys, at, digests, size = [], [], [], 0
                if keys:
                    yield rows()

    windows = spans.select(*KEY, "span").mapInPandas(run, "gram long, s1 long, s2 long, shape long, length int, a long, w1 long, w2 long")
    twice = windows.groupBy("length", "w1", "w2").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("length", "w1", "w2")
    return windows.join(twice, ["length", "w1", "w2"]).select(*KEY, "length", "a", F.col("a").alias("b"))


def repeats(texts: DataFrame, length: int = LENGTH, passage: int = PASSAGE, classes: int = CLASSES) -> DataFrame:
    """(d1, d2, length, a, b): runs of starts of repeated windows of both lengths in `texts` (d1, d2, text)."""
    # the lists of grams are kept, so that a join with them is a plain one whose frequent grams Spark can split
    often = checkpointed(grams(texts, passage).groupBy("gram").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("gram"))
    found = flagged(anchors(texts, length, passage), "gram", often).filter("maybe").drop("maybe")
    kept = checkpointed(found.join(often, "gram"))
    of_class = kept.groupBy(*KEY).agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("d1", "d2", "start")).alias("member"))
    of_class = checkpointed(of_class)
    several = checkpointed(of_class.groupBy("gram").agg(F.count(F.lit(1)).alias("classes")).filter("classes > 1"))
    mixed = of_class.join(several, "gram")
    # the bytes of one member of each class
    wanted = mixed.groupBy("member.d1", "member.d2").agg(F.collect_list(F.struct(*KEY, "classes", F.col("member.start").alias("start"))).alias("wanted"))
    wanted = checkpointed(wanted)

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out, size = [], 0
            for text, wanted in zip(batch["text"], batch["wanted"], strict=True):
                raw = text.encode("utf-8", "replace")
                for w in wanted:
                    span = raw[w["start"] : w["start"] + (w["shape"] >> SPAN_BITS)]
                    out.append((*(w[k] for k in KEY), w["classes"], span))
                    size += len(span)
                if size > 16_000_000:
                    yield pd.DataFrame(out, columns=[*KEY, "classes", "span"])
                    out, size = [], 0
            if out:
                yield pd.DataFrame(out, columns=[*KEY, "classes", "span"])

    one = flagged(texts, "d1", wanted.select("d1")).filter("maybe").select("d1", "d2", "text").dropDuplicates(["d1", "d2"]).join(wanted, ["d1", "d2"]).select("text", "wanted")
    spans = checkpointed(one.mapInPandas(cut, "gram long, s1 long, s2 long, shape long, classes long, span binary"))
    shared = _sorted_within(spans.filter(F.col("classes") <= classes), length, passage).unionByName(_grouped(spans.filter(F.col("classes") > classes), length, passage))
    starts = F.shiftright("shape", START_BITS).bitwiseAND(F.lit((1 << SPAN_BITS - START_BITS) - 1))
    lengths = F.explode(F.array(*[F.lit(n) for n in sorted({length, passage})])).alias("length")
    whole = of_class.filter("n > 1").select(*KEY, lengths, F.lit(0).cast("long").alias("a"))
    whole = whole.withColumn("b", F.least(starts, F.shiftright("shape", SPAN_BITS) - F.col("length") + 1) - 1).filter("b >= 0")
    runs = whole.unionByName(shared)
    return kept.join(runs, KEY).select("d1", "d2", "length", (F.col("start") + F.col("a")).alias("a"), (F.col("start") + F.col("b")).alias("b"))


RESULT = T.StructType([T.StructField(n, T.LongType()) for n in ("n_bytes", "n_removed", "n_spans")] + [T.StructField("kept_sha256", T.StringType()), T.StructField("n_repeated", T.LongType())])


def _without(raw: bytes, runs: list[tuple[int, int]]) -> tuple[list[bytes], int, int]:
    """What is left without the byte ranges, the bytes removed, and the maximal removed runs."""
    out, at, removed, spans = [], 0, 0, 0
    end = -1
    for a, b in sorted(runs):
        if a > end:
            out.append(raw[at:a])
            spans += 1
            end = a
        removed += max(0, b - end)
        at = end = max(end, b)
    return [*out, raw[at:]], removed, spans


def remove_repeats(docs: DataFrame, length: int = LENGTH, classes: int = CLASSES, passage: int = PASSAGE) -> DataFrame:
    """One row per row of `docs` (doc_id, text): doc_id, n_bytes, n_removed, n_spans, kept_sha256, n_repeated.

    Every byte covered by a `length`-byte string that also starts anywhere else is removed; windows never
    cross documents. n_repeated counts the bytes covered by such strings of `passage` bytes (8 at least, `length`
    at most), which are not removed. A null text counts as empty and keeps the empty string; a text shorter than
    a window keeps all. Rows with equal texts repeat each other and lose all that reaches `length` bytes; rows come
    back as often as they are there, null ids too. Other columns are not read; an empty table gives none.
    """
    text = F.coalesce("text", F.lit(""))
    keyed = docs.select("doc_id", text.alias("text")).select("doc_id", "text", F.xxhash64("text").alias("d1"), F.xxhash64(F.lit(length), "text").alias("d2"))
    runs = repeats(keyed.select("d1", "d2", "text"), length, passage, classes)
    by_text = checkpointed(runs.groupBy("d1", "d2").agg(F.collect_set(F.struct("length", "a", "b")).alias("runs")))

    def finish(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for texts, found in batches:
            out = []
            for t, r in zip(texts, found, strict=True):
                raw = t.encode("utf-8", "replace")
                ranges = {n: [(x["a"], x["b"] + n) for x in r if x["length"] == n] if r is not None else [] for n in {length, passage}}
                kept, removed, spans = _without(raw, ranges[length])
                sha = hashlib.sha256()
                for part in kept:
                    sha.update(part)
                out.append((len(raw), removed, spans, sha.hexdigest(), _without(raw, ranges[passage])[1] if ranges[passage] else 0))
            yield pd.DataFrame(out, columns=RESULT.names)

    finish.__annotations__ = {"batches": Iterator[tuple[pd.Series, pd.Series]], "return": Iterator[pd.DataFrame]}
    done = F.pandas_udf(finish, RESULT)
    rows = flagged(keyed, "d1", by_text.select("d1"))
    joined = rows.filter("maybe").join(by_text, ["d1", "d2"], "left").select("doc_id", "text", "runs")
    alone = rows.filter("not maybe").select("doc_id", "text", F.lit(None).cast(by_text.schema["runs"].dataType).alias("runs"))
    return joined.unionByName(alone).select("doc_id", done("text", "runs").alias("out")).select("doc_id", "out.*")


def op6_suffixes(spark, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents"))
