"""Language identification by prediction by partial matching (PPM).

Each language has a variable-order byte context tree of up to three bytes of context. The statistics
are frozen after training: a symbol seen n times in a context of N symbols, d of them distinct, has
probability n / (N + d); any other symbol pays the escape d / (N + d) and is looked up in the context
that is one byte shorter, down to 1 / 256. A text's score under a language is its exact code length,
the sum over all its bytes; the language with the shortest code wins.

Training counts the 4-grams of every training text with Spark (all lower orders are sums of these).
No count is dropped: the code lengths are kept in slices of contexts, files of at most about `MAX_CELLS`
cells in the folder that all executors share, as many as the grams need. A scoring task looks up the
distinct grams of its texts slice by slice, so its memory doesn't grow with the model. Only the table
of orders 0 and 1 (65 536 cells a language) and the slices' bounds are broadcast.
"""

from __future__ import annotations

import io
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..store import new_folder
from .common import checkpointed, held_out, table, with_columns_from

#: Most cells (4-grams x languages) of a slice of the model, unless one context of two bytes has more; 4 bytes each.
MAX_CELLS = 8_000_000
#: Distinct grams that a counting task holds before it passes them on.
HELD = 2_000_000
#: How many slices a task keeps.
KEPT = 2
START = b"\n\n\n"
#: Bytes of text that are cut into grams at a time; a scoring task holds the grams of twice as many, a counting task of eight times as many a language.
CHUNK = 1 << 17
#: Grams of a text whose costs are summed at a time.
PIECE = 1 << 16
RESULT = T.StructType([T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("bits_per_byte", T.DoubleType())])


def _grams(data: np.ndarray) -> np.ndarray:
    x = data.astype(np.uint32)
    return x[:-3] << 24 | x[1:-2] << 16 | x[2:-1] << 8 | x[3:]


def count_grams(docs: DataFrame) -> DataFrame:
    """(lang, gram, n): how often each 4-gram of bytes occurs in the lower-cased texts of each language.

    Rows with a null lang, and null or empty texts, teach nothing; repeated rows each count. Long texts are read
    in parts, with no gram lost between them.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[str, list[np.ndarray]] = {}
        size: dict[str, int] = {}
        sums: dict[str, pd.Series] = {}

        def fold(lang: str) -> None:
            grams, n = np.unique(np.concatenate(held.pop(lang)), return_counts=True)
            new = pd.Series(n, index=grams)
            sums[lang] = sums[lang].add(new, fill_value=0) if lang in sums else new
            size[lang] = 0

        def passed() -> Iterator[pd.DataFrame]:
            for lang in list(sums):
                s = sums.pop(lang)
                yield pd.DataFrame({"lang": lang, "gram": s.index.astype("int64"), "n": s.to_numpy().astype("int64")})

        for batch in batches:
            if sum(map(len, sums.values())) > HELD:
                yield from passed()
            for lang, text in zip(batch["lang"], batch["text"], strict=True):
                raw = START + text.lower().encode("utf-8", "replace")
                for at in range(0, len(raw) - 3, CHUNK):
                    held.setdefault(lang, []).append(_grams(np.frombuffer(raw[at : at + CHUNK + 3], np.uint8)))
                    size[lang] = size.get(lang, 0) + min(CHUNK, len(raw) - at)
                    if size[lang] > 8 * CHUNK:
                        fold(lang)
        for lang in list(held):
            fold(lang)
        yield from passed()

    rows = docs.select("lang", "text").filter("lang is not null and text is not null and text <> ''")
    return rows.mapInPandas(run, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def _escapes(ctx_lang: np.ndarray, seen: np.ndarray, cells: int) -> tuple[np.ndarray, np.ndarray]:
    """The escape cost of each context and language (0 where nothing was seen), and N + d."""
    total, kinds = np.bincount(ctx_lang, seen, cells), np.bincount(ctx_lang, minlength=cells)
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where(total > 0, -np.log2(kinds / (total + kinds)), 0).astype(np.float32), total + kinds


def _low_costs(lang: np.ndarray, pair: np.ndarray, n: np.ndarray, langs: int) -> np.ndarray:
    """Costs of orders 0 and 1, shape (65536, langs): row = byte before x 256 + byte."""
    out = np.empty((1 << 16, langs), np.float32)
    for k in range(langs):
        own = lang == k
        seen = np.bincount(pair[own], n[own], 1 << 16).reshape(256, 256)
        low = np.full(256, 8.0)
        for counts in (seen.sum(0)[None], seen):
            total, kinds = counts.sum(1, keepdims=True), (counts > 0).sum(1, keepdims=True)
            with np.errstate(divide="ignore", invalid="ignore"):
                low = np.where(counts > 0, -np.log2(counts / (total + kinds)), low + np.where(total > 0, -np.log2(kinds / (total + kinds)), 0))
        out[:, k] = low.reshape(-1)
    return out


def _slice_costs(gram: np.ndarray, lang: np.ndarray, n: np.ndarray, low: np.ndarray) -> dict[str, np.ndarray]:
    """Orders 2 and 3 of the grams of some contexts of two bytes: sorted keys, their costs and the contexts' escapes."""
    k = low.shape[1]
    out, below = {}, lambda keys: low[keys & 0xFFFF]
    for order, mask in ((2, 0xFFFFFF), (3, 0xFFFFFFFF)):
        cell, where = np.unique((gram & mask) * k + lang, return_inverse=True)
        seen = np.bincount(where, n, len(cell))
        keys, row = np.unique(cell // k, return_inverse=True)
        ctx, of = np.unique(keys >> 8, return_inverse=True)
        ctx_lang = of[row] * k + cell % k
        escape, whole = _escapes(ctx_lang, seen, len(ctx) * k)
        escape = escape.reshape(-1, k)
        cost = below(keys) + escape[of]
        cost[row, cell % k] = -np.log2(seen / whole[ctx_lang])
        out |= {f"key{order}": keys.astype(np.uint32), f"cost{order}": cost, f"ctx{order}": ctx.astype(np.uint32), f"escape{order}": escape}
        lower, lower_cost = keys, cost
        below = lambda keys: lower_cost[np.searchsorted(lower, keys & 0xFFFFFF)]  # noqa: B023, E731
    return out


def _find(sorted_keys: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where keys are in sorted_keys, and whether they are."""
    at = np.minimum(np.searchsorted(sorted_keys, keys), len(sorted_keys) - 1)
    return at, sorted_keys[at] == keys


def _file(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system and path of a file in the shared folder."""
    return (fs.LocalFileSystem(), "/" + uri[5:].lstrip("/")) if uri.startswith("file:") else fs.FileSystem.from_uri(uri)


class Model:
    """Code lengths in bits. `low` has orders 0 and 1; slice i has orders 2 and 3 of the contexts of two bytes from `bounds[i]` on."""

    def __init__(self, langs: list[str], low: np.ndarray, bounds: np.ndarray, files: list[str]):
        self.langs, self.low, self.bounds, self.files = langs, low, bounds, files
        self.kept: dict[int, dict[str, np.ndarray]] = {}

    def plain(self) -> tuple:
        """What `Model` takes, without a class of this package: a broadcast is read where the package may be missing."""
        return self.langs, self.low, self.bounds, self.files

    def slice(self, i: int) -> dict[str, np.ndarray]:
        if i not in self.kept:
            while len(self.kept) >= KEPT:
                del self.kept[next(iter(self.kept))]
            store, path = _file(self.files[i])
            with store.open_input_file(path) as f, np.load(io.BytesIO(f.read())) as arrays:
                self.kept[i] = dict(arrays)
        return self.kept[i]

    def costs(self, grams: np.ndarray) -> np.ndarray:
        """Bits of the last byte of each of the distinct `grams` under each language."""
        out = self.low[grams & 0xFFFF]
        of = np.searchsorted(self.bounds, grams >> 8 & 0xFFFF, "right") - 1
        for i in np.unique(of):
            own = np.flatnonzero(of == i)
            x, s = grams[own], self.slice(int(i))
            cost = out[own]
            for order, mask in ((2, 0xFFFFFF), (3, 0xFFFFFFFF)):
                keys = x & np.uint32(mask)
                at, there = _find(s[f"ctx{order}"], keys >> np.uint32(8))
                cost[there] += s[f"escape{order}"][at[there]]
                at, there = _find(s[f"key{order}"], keys)
                cost[there] = s[f"cost{order}"][at[there]]
            out[own] = cost
        return out

    def bits_of(self, texts: list[str]) -> list[tuple[np.ndarray, int]]:
        """Code length of each whole text under each language, and its bytes."""
        total, size = np.zeros((len(texts), len(self.langs))), []
        held: list[tuple[int, np.ndarray]] = []

        def flush() -> None:
            grams, at = np.unique(np.concatenate([g for _, g in held]), return_inverse=True)
            cost, end = self.costs(grams), 0
            for i, g in held:
                for start in range(end, end + len(g), PIECE):
                    total[i] += cost[at[start : min(start + PIECE, end + len(g))]].sum(0, dtype=np.float64)
                end += len(g)
            held.clear()

        waiting = 0
        for i, text in enumerate(texts):
            raw = np.frombuffer(START + text.lower().encode("utf-8", "replace"), np.uint8)
            size.append(len(raw) - len(START))
            for at in range(0, len(raw) - 3, CHUNK):
                held.append((i, _grams(raw[at : at + CHUNK + 3])))
                waiting += len(held[-1][1])
                if waiting > 2 * CHUNK:
                    flush()
                    waiting = 0
        if held:
            flush()
        return list(zip(total, size, strict=True))

    def bits(self, text: str) -> tuple[np.ndarray, int]:
        return self.bits_of([text])[0]


def train(docs: DataFrame) -> Model | None:
    """The model of docs' languages (columns text, lang), or None if there is nothing to learn from."""
    spark = docs.sparkSession
    counts = checkpointed(count_grams(docs))
    langs = sorted(r["lang"] for r in counts.select("lang").distinct().collect())
    if not langs:
        return None
    counts = counts.join(F.broadcast(spark.createDataFrame(list(enumerate(langs)), "k int, lang string")), "lang").select("k", "gram", "n")
    pairs = counts.groupBy("k", F.col("gram").bitwiseAND(F.lit(0xFFFF)).alias("pair")).agg(F.sum("n").alias("n")).toPandas()
    low = _low_costs(*(pairs[c].to_numpy() for c in ("k", "pair", "n")), len(langs))
    # contexts of two bytes, 65 536 at most, in runs of up to MAX_CELLS cells
    ctx = F.shiftright("gram", 8).bitwiseAND(F.lit(0xFFFF))
    sizes = counts.select("gram").distinct().groupBy(ctx.alias("ctx")).count().toPandas().sort_values("ctx")
    bounds, cells = [0], 0
    for c, n in zip(sizes["ctx"], sizes["count"] * len(langs), strict=True):
        if cells and cells + n > MAX_CELLS:
            bounds.append(int(c))
            cells = 0
        cells += n
    bounds = np.array(bounds)
    of = np.searchsorted(bounds, sizes["ctx"].to_numpy(), "right") - 1
    slices = spark.createDataFrame(list(zip(sizes["ctx"].tolist(), of.tolist(), strict=True)), "ctx int, slice int")
    folder, shared = new_folder(spark, "language"), spark.sparkContext.broadcast(low)

    def save(rows: pd.DataFrame) -> pd.DataFrame:
        i = int(rows["slice"].iloc[0])
        arrays = _slice_costs(rows["gram"].to_numpy(), rows["k"].to_numpy(), rows["n"].to_numpy(), shared.value)
        # a name of its own for each attempt of the task
        uri = f"{folder}/{i}-{uuid.uuid4().hex}.npz"
        buffer = io.BytesIO()
        np.savez(buffer, **arrays)
        store, path = _file(uri)
        store.create_dir(path.rsplit("/", 1)[0], recursive=True)
        with store.open_output_stream(path) as f:
            f.write(buffer.getvalue())
        return pd.DataFrame({"slice": [i], "file": [uri]})

    dealt = counts.withColumn("ctx", ctx.cast("int")).join(F.broadcast(slices), "ctx").select("slice", "k", "gram", "n")
    files = {r["slice"]: r["file"] for r in dealt.groupBy("slice").applyInPandas(save, "slice int, file string").collect()}
    return Model(langs, low, bounds, [files[i] for i in range(len(bounds))])


def identify(docs: DataFrame, model: Model | None, text: str = "text") -> DataFrame:
    """`docs` with a struct `_out` (lang_pred, score, bits_per_byte).

    score is the winner's share of the summed probabilities that all languages give to the text.
    A null, empty or letterless text gives ("und", 0.0, 0.0), any other (null, 0.0, 0.0) when there is no model.
    Ties go to the language that sorts first.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model and model.plain())

    def make():
        m = shared.value and Model(*shared.value)

        def each(values):
            out = [("und", 0.0, 0.0)] * len(values)
            lettered = [i for i, v in enumerate(values) if v is not None and any(map(str.isalpha, v))]
            if m is None:
                for i in lettered:
                    out[i] = None, 0.0, 0.0
                return out
            for i, (bits, n) in zip(lettered, m.bits_of([values[i] for i in lettered]) if lettered else [], strict=True):
                best = int(bits.argmin())
                out[i] = m.langs[best], float(1 / np.exp2(bits[best] - bits).sum()), float(bits[best] / n)
            return out

        return each

    return with_columns_from(docs, text, RESULT, make)


def language_of_documents(docs: DataFrame) -> DataFrame:
    """Trains on the rows of `docs` that are not held out and predicts all of them.

    A null text, or one without a letter, is `und` with score 0; if nothing can be learned, other texts get null and 0.
    Ties go to the language that sorts first. Rows come back as often as they are there; a null id is not held
    out. Other columns are not read; an empty table gives none.
    """
    model = train(docs.filter(~held_out(F.col("doc_id"))))
    out = identify(docs.select("doc_id", "text"), model)
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "_out.lang_pred", "_out.score", "_out.bits_per_byte")


def op1_language(spark, sf_dir: str) -> DataFrame:
    return language_of_documents(table(spark, sf_dir, "documents"))
