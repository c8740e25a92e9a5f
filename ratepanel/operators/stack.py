"""Time-ordered folds, out-of-fold predictions, blending and stacking."""

from __future__ import annotations

import logging
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

import numpy as np
from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ratepanel.operators.models import Trainer
from ratepanel.operators.prep import row_total

log = logging.getLogger(__name__)

# Fixed value: keeps a weight finite when a model makes no error.
WEIGHT_EPS = 1e-6


def folds(df: DataFrame, k: int = 5, position: str = "pos", out: str = "fold") -> DataFrame:
    """Number of the fold that validates a row; NULL for the head rows.

    With ``n`` rows a fold has ``n // (k + 1)`` of them, the last fold ends at
    the last row, and all rows before a fold train it.
    """
    rows = F.col("_rows")
    size = F.floor(rows / (k + 1))
    after_head = F.col(position) - (rows - k * size)
    number = F.when((size > 0) & (after_head >= 0), F.floor(after_head / size)).cast("int")
    return df.join(F.broadcast(row_total(df))).withColumn(out, number).drop("_rows")


def oof(
    df: DataFrame,
    trainers: Mapping[str, Trainer],
    k: int = 5,
    y: str = "target",
    position: str = "pos",
    ids: Sequence[str] = (),
) -> DataFrame:
    """Long (position, ids, fold, model, y, pred) on the held-out slices.

    A model that refuses the rows of a fold is left out of that fold; failed Spark jobs, such as
    those of lost executors, and lack of memory are raised. ``df`` is read once
    per fold and model: settle or persist it before.
    """
    marked = folds(df, k, position)
    parts: list[DataFrame] = []
    for f in range(k):
        # rows of earlier folds and the head, which no fold validates
        fit_rows = marked.where(F.coalesce(F.col("fold"), F.lit(-1)) < f)
        val_rows = marked.where(F.col("fold") == f)
        for name, trainer in trainers.items():
            try:
                scored = trainer(fit_rows, val_rows)
            except (Py4JJavaError, MemoryError):
                raise
            except Exception as error:  # noqa: BLE001 - a fit that refuses its rows skips the fold
                log.warning("fold %d failed for %s: %s", f, name, error)
                continue
            parts.append(
                scored.select(position, *ids, "fold", F.lit(name).alias("model"), F.col(y).alias("y"), "pred")
            )
    if not parts:
        raise ValueError("no model could be fitted on any fold")
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def fold_mae(preds: DataFrame, models: Sequence[str] | None = None) -> DataFrame:
    """Mean over folds of the fold MAE; infinite for a model without folds."""
    per_fold = preds.groupBy("model", "fold").agg(F.avg(F.abs(F.col("y") - F.col("pred"))).alias("_mae"))
    found = per_fold.groupBy("model").agg(F.avg("_mae").alias("mae"))
    if models is None:
        return found
    names = preds.sparkSession.createDataFrame([(m,) for m in models], "model string")
    return names.join(found, "model", "left").withColumn("mae", F.coalesce("mae", F.lit(float("inf"))))


def fill_oof(
    df: DataFrame, preds: DataFrame, models: Sequence[str], position: str = "pos", drop_head: bool = False
) -> DataFrame:
    """One prediction column per model beside the rows of ``df``; rows that no
    fold validated get the column mean, or are dropped."""
    wide = preds.groupBy(position).pivot("model", list(models)).agg(F.first("pred"))
    if drop_head:
        return df.join(wide, position)
    means = wide.agg(*[F.avg(m).alias(f"_mean_{i}") for i, m in enumerate(models)])
    joined = df.join(wide, position, "left").join(F.broadcast(means))
    filled = joined.withColumns({m: F.coalesce(m, f"_mean_{i}") for i, m in enumerate(models)})
    return filled.drop(*[f"_mean_{i}" for i in range(len(models))])


def align(flat: DataFrame, seq: DataFrame, offset: int, position: str = "pos", seq_position: str = "seq_pos") -> DataFrame:
    """Join sequence rows to flat rows: row ``i`` has sequence ``i - offset``."""
    moved = seq.withColumn(position, F.col(seq_position) + offset)
    return flat.join(moved, position)


def inverse_mae_weights(mae: DataFrame) -> DataFrame:
    """(model, weight), weights in proportion to 1 / error and summing to 1."""
    raw = mae.select("model", (1.0 / (F.col("mae") + WEIGHT_EPS)).alias("_raw"))
    total = raw.agg(F.sum("_raw").alias("_total"))
    return raw.join(F.broadcast(total)).select("model", (F.col("_raw") / F.col("_total")).alias("weight"))


def blend(preds: DataFrame, weights: DataFrame, ids: Sequence[str] = ("pos",), y: str | None = None) -> DataFrame:
    """Weighted sum of the model predictions of each row."""
    keep = [F.first(y).alias(y)] if y else []
    # one weight row per model
    joined = preds.join(F.broadcast(weights), "model")
    return joined.groupBy(*ids).agg(F.sum(F.col("weight") * F.col("pred")).alias("pred"), *keep)


@dataclass(frozen=True)
class Ridge:
    """A fitted linear meta model; small enough to be a plan constant."""

    columns: tuple[str, ...]
    weights: tuple[float, ...]
    intercept: float

    def expression(self) -> Column:
        out = F.lit(self.intercept)
        for c, w in zip(self.columns, self.weights):
            out = out + F.col(c) * F.lit(w)
        return out

    def predict(self, df: DataFrame, out: str = "pred") -> DataFrame:
        return df.withColumn(out, self.expression())

    def rows(self) -> list[tuple[str, float]]:
        return [*zip(self.columns, self.weights), ("(intercept)", self.intercept)]


def ridge(df: DataFrame, columns: Sequence[str], y: str = "y", alpha: float = 1.0) -> Ridge:
    """Ridge regression with a free intercept.

    The cluster reduces the rows to means and covariances, which are as many
    numbers as there are pairs of base models; only those are solved here.
    """
    columns = list(columns)
    pairs = [(i, j) for i in range(len(columns)) for j in range(i, len(columns))]
    found = df.agg(
        F.count(F.lit(1)).alias("n"),
        F.avg(y).alias("my"),
        *[F.avg(c).alias(f"m{i}") for i, c in enumerate(columns)],
        *[F.covar_pop(columns[i], columns[j]).alias(f"c{i}_{j}") for i, j in pairs],
        *[F.covar_pop(c, y).alias(f"t{i}") for i, c in enumerate(columns)],
    ).first()
    n, p = found["n"], len(columns)
    gram = np.zeros((p, p))
    for i, j in pairs:
        gram[i, j] = gram[j, i] = found[f"c{i}_{j}"] * n
    target = np.array([found[f"t{i}"] * n for i in range(p)])
    weights = np.linalg.solve(gram + alpha * np.eye(p), target)
    intercept = found["my"] - float(weights @ np.array([found[f"m{i}"] for i in range(p)]))
    return Ridge(tuple(columns), tuple(float(w) for w in weights), float(intercept))


# Meta learners.
STRATEGIES = ("ridge", "weighted")


def fit_meta(
    meta: DataFrame,
    models: Sequence[str],
    strategy: str = "ridge",
    y: str = "y",
    alpha: float = 1.0,
    mae: DataFrame | None = None,
) -> Ridge:
    """A meta model over one prediction column per base model."""
    if strategy == "ridge":
        return ridge(meta, models, y, alpha)
    if strategy == "weighted":
        if mae is None:
            raise ValueError("the weighted strategy needs the validation errors")
        weights = {r["model"]: r["weight"] for r in inverse_mae_weights(mae).collect()}
        return Ridge(tuple(models), tuple(float(weights[m]) for m in models), 0.0)
    raise ValueError(f"unknown strategy {strategy!r}, expected one of {', '.join(STRATEGIES)}")
