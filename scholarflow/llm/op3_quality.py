"""Quality classifier: regularised quadratic discriminant analysis over transformed document statistics.

Each class has a mean and a shrunken covariance; a text's score is the logistic of the difference of
the two log densities, each from a Mahalanobis distance by a Cholesky factor that is computed once.
The moments are summed by Spark over all labelled training rows; only they reach the driver.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import checkpointed, held_out, table, with_columns_from

STATISTICS = (
    "log_bytes", "log_words", "word_length", "word_length_sd", "symbols", "upper", "digits", "distinct_words",
    "top_word", "short_words", "repeated_lines", "log_line_length", "repeated_triples", "entropy",
)
FIELDS = T.StructType([T.StructField("x", T.ArrayType(T.DoubleType()))])
#: Weight of the pooled diagonal in a class covariance, besides d / (n + d); and the least variance.
SHRINK, RIDGE = 0.05, 1e-3

_KIND = np.zeros((256, 4))
_KIND[[c for c in range(33, 127) if not chr(c).isalnum() and chr(c) not in ".,;:'\"!?-()"], 0] = 1
_KIND[[ord("!"), ord("?")], 0] = 0.5
_KIND[range(65, 91), 1] = 1
_KIND[range(48, 58), 2] = 1
_KIND[[*range(65, 91), *range(97, 123), *range(128, 256)], 3] = 1


def statistics(text: str | None) -> list[float]:
    """The numbers of `STATISTICS`; shares pass through asin(sqrt(p)), counts through log(1 + n). Null counts as empty."""
    raw = (text or "").encode("utf-8", "replace")
    words = raw.split()
    n, w = max(1, len(raw)), max(1, len(words))
    bytes_ = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    symbols, upper, digits, letters = bytes_ @ _KIND
    p = bytes_[bytes_ > 0] / n
    lengths = np.fromiter(map(len, words), np.float64, len(words)) if words else np.zeros(1)
    counts = Counter(words)
    triples = len(set(zip(words, words[1:], words[2:]))) if len(words) > 2 else 1
    lines = raw.split(b"\n")
    share = lambda a, b: float(np.arcsin(np.sqrt(min(1.0, a / max(1, b)))))
    return [
        float(np.log1p(len(raw))), float(np.log1p(len(words))), float(np.log1p(lengths.mean())), float(np.log1p(lengths.std())),
        share(symbols, n), share(upper, letters), share(digits, n), share(len(counts), w),
        share(max(counts.values(), default=0), w), share(float((lengths <= 3).sum()), w), share(len(lines) - len(set(lines)), len(lines)),
        float(np.log1p(n / len(lines))), share(max(1, len(words) - 2) - triples, max(1, len(words) - 2)), float(-(p * np.log2(p)).sum()),
    ]


def document_statistics(docs: DataFrame, text: str = "text") -> DataFrame:
    return with_columns_from(docs, text, FIELDS, lambda: lambda values: [(statistics(v),) for v in values])


def moments(rows: DataFrame) -> dict[int, tuple[float, np.ndarray, np.ndarray]]:
    """Per class (columns x, y): number of rows, mean, covariance. Sums are taken by Spark."""
    d = len(STATISTICS)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            x, y = np.array(batch["x"].tolist()).reshape(len(batch), d), batch["y"].to_numpy()
            x = np.concatenate([np.ones((len(x), 1)), x], 1)
            for c in np.unique(y):
                own = x[y == c]
                sums[int(c)] = sums.get(int(c), 0) + own.T @ own
        for c, s in sums.items():
            yield pd.DataFrame({"y": c, "k": np.arange(s.size), "v": s.ravel()})

    got = rows.select("x", "y").mapInPandas(run, "y int, k int, v double").groupBy("y", "k").agg(F.sum("v").alias("v")).toPandas()
    out = {}
    for c, part in got.groupby("y"):
        s = part.sort_values("k")["v"].to_numpy().reshape(d + 1, d + 1)
        mean = s[0, 1:] / s[0, 0]
        out[int(c)] = s[0, 0], mean, s[1:, 1:] / s[0, 0] - np.outer(mean, mean)
    return out


class Discriminant:
    """Two Gaussians with shrunken covariances and their cached Cholesky factors."""

    def __init__(self, classes: dict[int, tuple[float, np.ndarray, np.ndarray]]):
        self.n = {c: classes.get(c, (0.0,))[0] for c in (0, 1)}
        self.only = None if all(self.n.values()) else (self.n[1] + 1) / (self.n[0] + self.n[1] + 2)
        if self.only is not None:
            return
        total = sum(self.n.values())
        pooled = sum(self.n[c] * classes[c][2] for c in (0, 1)) / total
        mean = sum(self.n[c] * classes[c][1] for c in (0, 1)) / total
        spread = sum(self.n[c] * (classes[c][2] + np.outer(classes[c][1] - mean, classes[c][1] - mean)) for c in (0, 1)) / total
        self.scale = np.sqrt(np.maximum(np.diag(spread), 1e-9))
        self.mean, self.inverse, self.constant = [], [], []
        for c in (0, 1):
            n, mu, cov = classes[c]
            d = len(mu)
            alpha = min(1.0, SHRINK + d / (n + d))
            cov = ((1 - alpha) * cov + alpha * np.diag(np.diag(pooled))) / np.outer(self.scale, self.scale) + RIDGE * np.eye(d)
            chol = np.linalg.cholesky(cov)
            self.mean.append(mu)
            self.inverse.append(np.linalg.inv(chol))
            self.constant.append(np.log(n / total) - np.log(np.diag(chol)).sum())

    @classmethod
    def of(cls, fields: dict) -> Discriminant:
        out = cls.__new__(cls)
        out.__dict__.update(fields)
        return out

    def scores(self, x: np.ndarray) -> np.ndarray:
        """Probability of class 1 for each row of statistics."""
        if self.only is not None:
            return np.full(len(x), self.only)
        logs = [k - 0.5 * ((((x - mu) / self.scale) @ inv.T) ** 2).sum(1) for mu, inv, k in zip(self.mean, self.inverse, self.constant, strict=True)]
        return 1 / (1 + np.exp(np.clip(logs[0] - logs[1], -700, 700)))


def quality_of_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per row of `docs` (doc_id, text); learns from `labels` (doc_id, quality) that are not held out.

    Rows with a null label or id teach nothing; repeated labels each count. With one class or none to
    learn from, every score is the smoothed share of class 1 (0.5 for none).
    """
    stats = checkpointed(document_statistics(docs.select("doc_id", "text")).select("doc_id", F.col("_out.x").alias("x")))
    y = labels.select(F.col("doc_id").alias("_id"), F.col("quality").cast("int").alias("y")).filter("y in (0, 1)").filter(~held_out(F.col("_id")))
    model = Discriminant(moments(stats.join(y, stats["doc_id"] == y["_id"])))
    # its plain fields: a broadcast is read where the package may be missing
    shared = stats.sparkSession.sparkContext.broadcast(vars(model))

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        own = Discriminant.of(shared.value)
        for x in batches:
            yield pd.Series(own.scores(np.array(x.tolist()).reshape(len(x), len(STATISTICS))))

    run.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
    score = F.round(F.pandas_udf(run, T.DoubleType())("x"), 9)
    return stats.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), score.alias("score")).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def op3_quality(spark, sf_dir: str) -> DataFrame:
    return quality_of_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
