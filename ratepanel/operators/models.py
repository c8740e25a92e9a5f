"""Base regressors on MLlib, their presets, search, ranking and spread."""

from __future__ import annotations

import math
import random
from collections.abc import Callable, Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from typing import Any

from pyspark.ml import Estimator, Model
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ratepanel.operators.prep import split

# Training presets. A 63-leaf tree is a tree of depth 6.
PRESETS: dict[str, tuple[type, dict[str, Any]]] = {
    "boosted_a": (
        GBTRegressor,
        dict(
            maxIter=800,
            stepSize=0.05,
            maxDepth=7,
            subsamplingRate=0.8,
            featureSubsetStrategy="0.8",
            minInstancesPerNode=3,
            seed=42,
        ),
    ),
    "boosted_b": (
        GBTRegressor,
        dict(
            maxIter=800,
            stepSize=0.05,
            maxDepth=6,
            subsamplingRate=0.8,
            featureSubsetStrategy="0.8",
            minInstancesPerNode=20,
            seed=42,
        ),
    ),
    "forest": (RandomForestRegressor, dict(numTrees=800, maxDepth=7, subsamplingRate=0.8, seed=42)),
    "linear": (LinearRegression, dict(solver="normal")),
}

# Searched ranges (low, high, kind).
SEARCH_SPACE: dict[str, tuple[float, float, str]] = {
    "maxIter": (300, 1200, "int"),
    "stepSize": (1e-3, 0.3, "log"),
    "maxDepth": (3, 10, "int"),
    "subsamplingRate": (0.5, 1.0, "float"),
    "featureSubsetStrategy": (0.5, 1.0, "share"),
    "minInstancesPerNode": (1, 10, "int"),
}
SEARCH_TRIALS = 50
EARLY_STOP_TOLERANCE = 1e-4


def preset(name: str, overrides: Mapping[str, Any] | None = None) -> Estimator:
    """A configured estimator by preset name."""
    if name not in PRESETS:
        raise ValueError(f"unknown preset {name!r}, expected one of {', '.join(PRESETS)}")
    kind, params = PRESETS[name]
    return kind(featuresCol="features", labelCol="target", predictionCol="pred", **{**params, **(overrides or {})})


def assemble(df: DataFrame, columns: Sequence[str], out: str = "features") -> DataFrame:
    return VectorAssembler(inputCols=list(columns), outputCol=out, handleInvalid="error").transform(df)


def mark_validation(df: DataFrame, ratio: float = 0.9, out: str = "is_val", **names: str) -> DataFrame:
    """The latest rows of every key, taken from the training rows, steer early
    stopping; test rows never do."""
    marked = split(df, ratio, "per_key_time", out="_early", **names)
    return marked.withColumn(out, ~F.col("_early")).drop("_early")


def train(df: DataFrame, estimator: Estimator, val_col: str | None = None, tolerance: float = EARLY_STOP_TOLERANCE) -> Model:
    """Fit; with ``val_col`` boosting stops when validation stops improving."""
    if val_col is None:
        return estimator.fit(df)
    if estimator.hasParam("validationIndicatorCol"):
        stop = {
            estimator.getParam("validationIndicatorCol"): val_col,
            estimator.getParam("validationTol"): tolerance,
        }
        return estimator.fit(df, stop)
    return estimator.fit(df.where(~F.col(val_col)))


def draw_trials(space: Mapping[str, tuple[float, float, str]], n: int, seed: int = 42) -> list[dict[str, Any]]:
    """``n`` parameter sets, the same for the same seed."""
    rng = random.Random(seed)

    def draw(low: float, high: float, kind: str) -> Any:
        if kind == "int":
            return rng.randint(int(low), int(high))
        if kind == "log":
            return math.exp(rng.uniform(math.log(low), math.log(high)))
        value = rng.uniform(low, high)
        return f"{value:.4f}" if kind == "share" else value

    return [{name: draw(*rule) for name, rule in space.items()} for _ in range(n)]


def search(
    df: DataFrame,
    estimator: Estimator,
    space: Mapping[str, tuple[float, float, str]] | None = None,
    n: int = SEARCH_TRIALS,
    val_col: str = "is_val",
    label: str = "target",
    seed: int = 42,
    parallelism: int = 4,
) -> tuple[Model, dict[str, Any], DataFrame]:
    """Lowest validation MSE over drawn parameter sets.

    The validation rows come from ``val_col``, so that the split can follow
    time. Returns the winner refitted, its parameters and the trial table.
    """
    spark = df.sparkSession
    trials = draw_trials(space or SEARCH_SPACE, n, seed)
    fit_rows, val_rows = df.where(~F.col(val_col)), df.where(F.col(val_col))

    def run(params: dict[str, Any]) -> float:
        chosen = {estimator.getParam(k): v for k, v in params.items()}
        scored = estimator.fit(fit_rows, chosen).transform(val_rows)
        return scored.agg(F.avg(F.pow(F.col(label) - F.col(estimator.getPredictionCol()), 2))).first()[0]

    with ThreadPoolExecutor(parallelism) as pool:
        losses = list(pool.map(run, trials))
    winner = min(range(n), key=lambda i: losses[i])
    table = spark.createDataFrame(
        [(i, str(t), float(loss)) for i, (t, loss) in enumerate(zip(trials, losses))],
        "trial int, params string, mse double",
    )
    chosen = {estimator.getParam(k): v for k, v in trials[winner].items()}
    return estimator.fit(fit_rows, chosen), trials[winner], table


# --- ranking ----------------------------------------------------------------


def _ranked(spark_rows: DataFrame) -> DataFrame:
    """One row per feature, so the ranking window is as small as the model."""
    order = Window.orderBy(F.desc("score"), F.asc("feature"))
    return spark_rows.select("feature", "score", F.row_number().over(order).alias("rank"))


def linear_contributions(df: DataFrame, weights: Mapping[str, float]) -> DataFrame:
    """Mean absolute contribution per feature of a linear model, which is
    exact: ``|w * (x - mean(x))|``."""
    columns = list(weights)
    means = df.agg(*[F.avg(c).alias(f"_mean_{i}") for i, c in enumerate(columns)])
    share = [
        F.avg(F.abs((F.col(c) - F.col(f"_mean_{i}")) * float(weights[c]))).alias(f"_s{i}") for i, c in enumerate(columns)
    ]
    wide = df.select(*columns).join(F.broadcast(means)).agg(*share)
    rows = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(f"_s{i}").alias("score")) for i, c in enumerate(columns)])
    return wide.select(F.inline(rows))


def rank_features(model: Model, df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(feature, score, rank), the most important first."""
    if hasattr(model, "coefficients"):
        weights = {c: float(w) for c, w in zip(columns, model.coefficients)}
        return _ranked(linear_contributions(df, weights))
    scores = [(c, float(v)) for c, v in zip(columns, model.featureImportances.toArray())]
    return _ranked(df.sparkSession.createDataFrame(scores, "feature string, score double"))


def rank_scores(scores: DataFrame) -> DataFrame:
    return _ranked(scores)


def low_importance(ranking: DataFrame, share: float = 0.2) -> DataFrame:
    """Features with a score at or below the ``share`` quantile."""
    limit = ranking.agg(F.percentile("score", F.lit(share)).alias("_limit"))
    return ranking.join(F.broadcast(limit)).where(F.col("score") <= F.col("_limit")).drop("_limit")


# --- spread -----------------------------------------------------------------


def bagged(df: DataFrame, estimator: Estimator, n: int, seed: int = 42) -> list[Model]:
    """The same estimator with ``n`` seeds; row sampling makes them differ."""
    return [estimator.fit(df, {estimator.getParam("seed"): seed + i}) for i in range(n)]


def sample_predictions(df: DataFrame, models: Sequence[Model], ids: Sequence[str]) -> DataFrame:
    """Long (ids, sample, pred): all models score a row in one pass."""
    columns = df.columns
    for i, model in enumerate(models):
        df = model.transform(df, {model.getParam("predictionCol"): f"_pred_{i}"}).select(
            *columns, *[f"_pred_{k}" for k in range(i + 1)]
        )
    rows = F.posexplode(F.array(*[f"_pred_{i}" for i in range(len(models))])).alias("sample", "pred")
    return df.select(*ids, rows)


def spread(preds: DataFrame, ids: Sequence[str], pred: str = "pred") -> DataFrame:
    """Mean and population deviation of the samples of each row."""
    return preds.groupBy(*ids).agg(F.avg(pred).alias("mean"), F.stddev_pop(pred).alias("std"))


def feature_array(df: DataFrame, features: str = "features") -> DataFrame:
    return df.withColumn("x", vector_to_array(features))


# --- baselines --------------------------------------------------------------

# Feature columns used as forecasts.
BASELINES = ("lag_1", "SMA_5", "SMA_20", "EMA_12")


def baseline_predictions(
    df: DataFrame, ids: Sequence[str], y: str = "rate", columns: Sequence[str] = BASELINES
) -> DataFrame:
    """Long (ids, y, model, pred), one model per feature column."""
    each = F.array(*[F.struct(F.lit(c).alias("model"), F.col(c).alias("pred")) for c in columns])
    return df.select(*ids, F.col(y).alias("y"), F.inline(each))


Trainer = Callable[[DataFrame, DataFrame], DataFrame]


def mllib_trainer(estimator: Estimator) -> Trainer:
    """Fit on the first frame, add ``pred`` to the second."""

    def run(fit_rows: DataFrame, val_rows: DataFrame) -> DataFrame:
        return estimator.fit(fit_rows).transform(val_rows)

    return run


def column_trainer(column: str) -> Trainer:
    """A forecaster that needs no fitting."""

    def run(fit_rows: DataFrame, val_rows: DataFrame) -> DataFrame:
        return val_rows.withColumn("pred", F.col(column))

    return run
