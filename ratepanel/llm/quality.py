"""Quality classifier: regularised quadratic discriminant over document statistics.

Each text becomes a dozen transformed statistics. Each class keeps its mean and
its covariance, shrunk to the covariance within classes and to its diagonal. The
score is the logistic of the log-density difference plus the log prior odds; the
densities come from Mahalanobis distances with the inverse Cholesky factors, kept
once per model.

The fit is two small aggregates over all labelled rows, so no sample is taken.

Defined results: null and empty texts have the statistics of an empty text and a
score like any other; labels other than 0 and 1, or null, are not learnt from; a
document with several labels counts once with each; repeated rows count each time.
With labels of one class only, the score is that class's 0 or 1; with none it is
0.5. Columns other than those named are neither read nor clash.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ratepanel.llm.common import byte_texts, identified, remainder, without
from ratepanel.session import settle

SYMBOLS = b"#$%&*|!@^~<>=+\\_{}[]`/"
MARKS = b".,;:?'\"()-"
UPPER = bytes(range(65, 91))
LOWER = bytes(range(97, 123))
DIGITS = b"0123456789"
BROAD = bytes(range(128, 256))
NO_LETTER = re.compile(rb"[^A-Za-z\x80-\xff]+")
SIZE = 12
THRESHOLD = 0.3


def statistics(text: bytes) -> list[float]:
    words = text.split()
    n, size = len(words), len(text)
    at = 1.0 / (size + 1)
    n_words = 1.0 / (n + 1)
    left = lambda drop: size - len(text.translate(None, drop))
    upper, lower, broad = left(UPPER), left(LOWER), left(BROAD)
    counts = Counter(words)
    lines = [line for line in text.split(b"\n") if line]
    odd = sum(k for word, k in counts.items() if NO_LETTER.fullmatch(word))
    repeats = sum(map(eq, words, words[1:]))
    return [
        np.log1p(n),
        np.log((size + 1) * n_words),
        np.log(left(SYMBOLS) * at + 0.002),
        np.log(upper / (upper + lower + broad + 1) + 0.01),
        np.log(left(DIGITS) * at + 0.002),
        np.log((len(counts) + 1) * n_words),
        np.log(repeats * n_words + 0.005),
        np.log((max(counts.values(), default=0) + 1) * n_words),
        np.log(left(MARKS) * n_words + 0.01),
        np.log(text.count(b"\n") * n_words + 0.005),
        np.log(1 - len(set(lines)) / (len(lines) + 1e-9) + 0.02) if lines else np.log(0.02),
        np.log(odd * n_words + 0.005),
    ]


def statistics_column(text: str = "text") -> Column:
    @F.arrow_udf("array<double>")
    def run(texts: pa.Array) -> pa.Array:
        return pa.array([statistics(t) for t in byte_texts(texts)], pa.list_(pa.float64()))

    return run(F.col(text))


@dataclass(frozen=True)
class Model:
    """Prior odds, and for each class the mean, inverse Cholesky factor and log determinant."""

    odds: float
    means: np.ndarray | None = None
    factors: np.ndarray | None = None
    log_dets: np.ndarray | None = None

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.means is None:
            return np.full(len(x), 1.0 if self.odds > 0 else 0.0 if self.odds < 0 else 0.5)
        density = [
            -0.5 * (np.square((x - m) @ f.T).sum(axis=1) + d)
            for m, f, d in zip(self.means, self.factors, self.log_dets)
        ]
        z = np.clip(density[1] - density[0] + self.odds, -500.0, 500.0)
        return 1.0 / (1.0 + np.exp(-z))


def fit(labelled: DataFrame, pooled: float = 0.2, diagonal: float = 0.05) -> Model:
    """``labelled`` has ``quality`` and ``stats``. ``pooled`` and ``diagonal`` are the
    shares of the covariance within classes and of its diagonal in each class's."""
    x = [F.col("stats")[i] for i in range(SIZE)]
    pairs = [(i, j) for i in range(SIZE) for j in range(i, SIZE)]
    rows = (
        labelled.where(F.col("quality").isin(0, 1))
        .groupBy("quality")
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.array(*[F.sum(v) for v in x]).alias("sums"),
            F.array(*[F.sum(x[i] * x[j]) for i, j in pairs]).alias("products"),
        )
        .collect()
    )
    found = {int(r["quality"]): r for r in rows}
    if len(found) < 2:
        return Model(odds=0.0 if not found else 1.0 if 1 in found else -1.0)
    n = np.array([found[k]["n"] for k in (0, 1)], dtype=float)
    means = np.array([found[k]["sums"] for k in (0, 1)]) / n[:, None]
    scatter = np.zeros((2, SIZE, SIZE))
    for k in (0, 1):
        for (i, j), v in zip(pairs, found[k]["products"]):
            scatter[k, i, j] = scatter[k, j, i] = v / n[k] - means[k, i] * means[k, j]
    within = (n[:, None, None] * scatter).sum(axis=0) / n.sum()
    spread = np.diag(np.diag(within)) + 1e-4 * np.eye(SIZE)
    factors, log_dets = [], []
    for k in (0, 1):
        covariance = (1 - pooled - diagonal) * scatter[k] + pooled * within + diagonal * spread + 1e-6 * np.eye(SIZE)
        root = np.linalg.cholesky(covariance)
        factors.append(np.linalg.inv(root))
        log_dets.append(2 * np.log(np.diag(root)).sum())
    return Model(float(np.log(n[1] / n[0])), means, np.array(factors), np.array(log_dets))


def score_column(model: Model, stats: str = "stats") -> Column:
    @F.arrow_udf("double")
    def run(column: pa.Array) -> pa.Array:
        x = column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), SIZE)
        return pa.array(model.score(x), pa.float64())

    return run(F.col(stats))


def score_documents(docs: DataFrame, labels: DataFrame, folds: int = 5, held: int = 0) -> DataFrame:
    """``doc_id, text_hash, held_out, score, predicted`` for each row of ``docs``.

    Labels of rows whose ``remainder`` is ``held`` are not learnt from.
    """
    stats = settle(
        identified(
            docs, (remainder(F.col("doc_id"), folds) == held).alias("held_out"), statistics_column().alias("stats")
        )
    )
    marks = labels.select("doc_id", "quality").where(F.col("quality").isNotNull())
    model = fit(stats.where(~F.col("held_out")).join(marks, "doc_id"))
    scored = stats.select("doc_id", "text_hash", "held_out", score_column(model).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that are not rejected."""
    rejected = score_documents(docs, labels).where(F.col("predicted") == 0)
    return without(docs, rejected)
