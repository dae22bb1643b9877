"""Quality classifier: regularised quadratic discriminant over document statistics.

Each text becomes a vector of transformed statistics. Both classes get a mean
and a covariance from sums that are added up across partitions; covariances are
shrunk towards the pooled one and its diagonal. The score is the logistic of
the difference of log densities (Mahalanobis distances by Cholesky factors,
computed once) plus that of the log priors.

Cases: a null text counts as empty and gets a score like any other; labels that
are null or of no document are ignored; without both classes every score is the
share of label 1 (0.5 without any label); documents and labels may repeat, each
row counts; an empty table gives no rows; further columns are kept by ``keep``.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siltstone.llm.text import utf8

SHRINK_POOLED, SHRINK_DIAGONAL = 0.1, 0.05
_UPPER, _LOWER = slice(65, 91), slice(97, 123)
_DIGIT = slice(48, 58)
_MARKS = np.frombuffer(b"#$%&*+<=>@[\\]^_`{|}~", dtype=np.uint8)
_STOPS = np.frombuffer(b".,;:", dtype=np.uint8)
NAMES = ("words", "word_length", "longest_word", "upper", "digits", "marks", "stops", "shouts", "high_bytes", "distinct_words", "repeated_threes", "repeated_lines", "line_words", "top_word", "short_words", "all_upper_words")


def statistics(text: bytes | None) -> list[float]:
    """The transformed statistics of one text, in the order of NAMES."""
    text = text or b""
    n = max(1, len(text))
    by = np.bincount(np.frombuffer(text, dtype=np.uint8), minlength=256)
    root = lambda x: math.sqrt(x / n)
    found = text.split()
    count = max(1, len(found))
    lengths = np.fromiter(map(len, found), dtype=np.int64, count=len(found))
    seen: dict[bytes, int] = {}
    for w in found:
        seen[w] = seen.get(w, 0) + 1
    threes = max(0, len(found) - 2)
    lines = [x for x in text.split(b"\n") if x.strip()]
    loud = sum(1 for w in found if len(w) > 1 and w.isupper())
    return [
        math.log1p(len(found)),
        math.log1p(lengths.mean() if found else 0.0),
        math.log1p(lengths.max(initial=0)),
        root(by[_UPPER].sum()),
        root(by[_DIGIT].sum()),
        root(by[_MARKS].sum()),
        root(by[_STOPS].sum()),
        root(by[33] + by[63]),
        root(by[128:].sum()),
        math.log((len(seen) + 1) / (count + 1)),
        math.sqrt(1 - len(set(zip(found, found[1:], found[2:], strict=False))) / threes) if threes else 0.0,
        math.sqrt(1 - len(set(lines)) / len(lines)) if lines else 0.0,
        math.log1p(count / max(1, len(lines))),
        math.sqrt(max(seen.values(), default=0) / count),
        (lengths <= 3).sum() / count,
        math.sqrt(loud / count),
    ]


@F.arrow_udf(T.ArrayType(T.DoubleType()))
def _statistics(text: pa.Array) -> pa.Array:
    return pa.array([statistics(t) for t in utf8(text)], type=pa.list_(pa.float64()))


def with_statistics(docs: DataFrame, into: str = "stats", text_col: str = "text") -> DataFrame:
    """``docs`` with the statistics of each text in a further column."""
    return docs.withColumn(into, _statistics(F.col(text_col)))


def document_statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and its statistics, one row for each row of ``docs``."""
    return with_statistics(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")), "stats").select("doc_id", "stats")


@dataclass
class Discriminant:
    """Per class: mean and inverse Cholesky factor of the covariance, with the log of its determinant; None if there are no two classes."""

    means: np.ndarray | None
    whiten: np.ndarray | None
    offset: float
    share: float

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.means is None or self.whiten is None:
            return np.full(len(x), self.share)
        far = [np.square((x - m) @ w.T).sum(axis=1) for m, w in zip(self.means, self.whiten, strict=True)]
        return 1 / (1 + np.exp(-np.clip(0.5 * (far[0] - far[1]) + self.offset, -40, 40)))


def fit(labelled: DataFrame) -> Discriminant:
    """From rows (stats, label): counts, sums and products add up across partitions."""
    d = len(NAMES)

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, 1 + d + d * d))
        for batch in batches:
            x = batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(-1, d)
            y = batch.column(1).to_numpy(zero_copy_only=False)
            for c in (0, 1):
                own = x[y == c]
                total[c] += np.r_[len(own), own.sum(axis=0), (own.T @ own).ravel()]
        yield pa.RecordBatch.from_arrays([pa.array([0, 1], type=pa.int32()), pa.array(total.tolist(), type=pa.list_(pa.float64()))], names=["label", "sums"])

    parts = labelled.select("stats", F.col("label").cast("int").alias("label")).filter("label in (0, 1)").mapInArrow(sums, "label int, sums array<double>")
    added = parts.select("label", F.posexplode("sums")).groupBy("label", "pos").agg(F.sum("col").alias("v")).collect()
    total = np.zeros((2, 1 + d + d * d))
    for r in added:  # 2 x (1 + d + d^2) numbers, whatever the input
        total[r["label"], r["pos"]] = r["v"]
    n = total[:, 0]
    if min(n) < 2:
        return Discriminant(None, None, 0.0, float(n[1] / n.sum()) if n.sum() else 0.5)
    means = total[:, 1 : d + 1] / n[:, None]
    own = [total[c, d + 1 :].reshape(d, d) / n[c] - np.outer(means[c], means[c]) for c in (0, 1)]
    pooled = (n[0] * own[0] + n[1] * own[1]) / n.sum()
    floor = np.diag(np.maximum(np.diag(pooled), 1e-6))
    whiten, logdet = [], []
    for s in own:
        shrunk = (1 - SHRINK_POOLED - SHRINK_DIAGONAL) * s + SHRINK_POOLED * pooled + SHRINK_DIAGONAL * floor
        factor = np.linalg.cholesky(shrunk + 1e-9 * np.eye(d))
        whiten.append(np.linalg.inv(factor))
        logdet.append(2 * np.log(np.diag(factor)).sum())
    return Discriminant(means, np.array(whiten), float(0.5 * (logdet[0] - logdet[1]) + math.log(n[1] / n[0])), float(n[1] / n.sum()))


def train(stats: DataFrame, labels: DataFrame, target: str = "quality", id_col: str = "doc_id", rows: Column | None = None) -> Discriminant:
    """``rows``: which of the labels to learn from."""
    chosen = labels if rows is None else labels.filter(rows)
    return fit(stats.join(chosen.select(F.col(id_col).alias("doc_id"), F.col(target).alias("label")), "doc_id"))


def scored(stats: DataFrame, model: Discriminant) -> DataFrame:
    """doc_id and score."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, len(NAMES))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.score(x))], names=["doc_id", "score"])

    return stats.select("doc_id", "stats").mapInArrow(run, "doc_id long, score double")


def keep(known: DataFrame, model: Discriminant, least: float, stats: str = "stats") -> DataFrame:
    """The rows of ``known`` (from ``with_statistics``) whose text scores ``least``
    or more, with all their other columns. Only statistics go to Python."""

    @F.arrow_udf(T.DoubleType())
    def score(x: pa.Array) -> pa.Array:
        return pa.array(model.score(x.flatten().to_numpy(zero_copy_only=False).reshape(-1, len(NAMES))))

    return known.filter(score(F.col(stats)) >= least).drop(stats)
