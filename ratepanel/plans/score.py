"""Scoring with a saved run, in batch and on request rows."""

from __future__ import annotations

from dataclasses import dataclass
from typing import Any

from pyspark.ml import Model
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ratepanel.operators import intervals, models, prep
from ratepanel.operators.layout import open_series
from ratepanel.operators.stack import Ridge
from ratepanel.plans.train import feature_frame
from ratepanel.sources.rates import split_valid
from ratepanel.sources.sinks import CATEGORIES, INTERVALS, KEY_SCALERS, TARGET_SCALER, RunStore, load_params

STACKING = "stacking"
DIGITS = 6
RETURN_MODES = ("log_return", "pct_change")

# columns that pass through scoring untouched
CARRIED = ("input_pos",)
NEW = "_is_new"
PREVIOUS = "_prev_rate"


@dataclass
class Run:
    """What scoring needs from a saved run."""

    run_id: str
    base: str
    manifest: dict[str, Any]
    robust: DataFrame
    target_range: DataFrame
    keys: DataFrame
    base_models: dict[str, Model]
    # none in runs saved without them
    widths: DataFrame | None = None

    @property
    def available(self) -> list[str]:
        return [*self.base_models, STACKING]

    @property
    def meta(self) -> Ridge:
        m = self.manifest["meta"]
        return Ridge(tuple(m["columns"]), tuple(m["weights"]), m["intercept"])


def load_run(store: RunStore, run_id: str | None = None) -> Run:
    run_id = run_id or store.latest()
    base, manifest = store.path(run_id), store.manifest(run_id)
    return Run(
        run_id,
        base,
        manifest,
        load_params(store.spark, base, KEY_SCALERS),
        load_params(store.spark, base, TARGET_SCALER),
        load_params(store.spark, base, CATEGORIES),
        {name: store.load_model(name, run_id) for name in manifest["presets"]},
        load_params(store.spark, base, INTERVALS) if "interval_level" in manifest else None,
    )


def choose(run: Run, model: str) -> str:
    if model not in run.available:
        raise ValueError(f"unknown model {model!r}, available: {', '.join(run.available)}")
    return model


def score_features(df: DataFrame, run: Run, model: str = STACKING) -> DataFrame:
    """Predicted rates for a frame that already has the features.

    The meta model is fed the predictions of the base models.
    """
    choose(run, model)
    manifest = run.manifest
    rows = prep.apply_robust(df, run.robust, manifest["scaled"])
    rows = models.assemble(prep.one_hot_vector(rows, run.keys), manifest["columns"])
    needed = run.meta.columns if model == STACKING else (model,)
    for name in needed:
        rows = run.base_models[name].transform(rows).withColumnRenamed("pred", name)
    rows = run.meta.predict(rows) if model == STACKING else rows.withColumn("pred", F.col(model))
    rows = prep.invert_minmax(rows, run.target_range, "pred", "target")
    keep = [c for c in df.columns if c in ("key", "date", "rate", NEW, PREVIOUS, *CARRIED)]
    return rows.select(*keep, "pred")


def score_batch(
    panel: DataFrame,
    run: Run,
    model: str = STACKING,
    history: DataFrame | None = None,
    remove_outliers: bool = False,
    rows_per_block: int | None = None,
) -> DataFrame:
    """One predicted rate per row of ``panel`` that has enough history, with its uncertainty: half the
    width of the interval that held ``interval_level`` of the run's test rows.

    ``history`` holds earlier rates of the same keys; it feeds lags and
    averages but is not scored, so short requests lose no rows.
    """
    choose(run, model)
    cfg = run.manifest["features"]
    rows, _ = split_valid(panel)
    rows = rows.select("key", "date", "rate", *[c for c in CARRIED if c in panel.columns])
    rows = rows.withColumn(NEW, F.lit(True))
    if history is not None:
        earlier = history.select("key", "date", "rate").join(rows.select("key", "date"), ["key", "date"], "left_anti")
        rows = rows.unionByName(earlier.withColumn(NEW, F.lit(False)), allowMissingColumns=True)
    mode = cfg["target"]["mode"]
    if mode in RETURN_MODES:
        columns = rows.columns
        s, laid = open_series(rows, 1, rows_per_block=rows_per_block)
        rows = s.close(laid.withColumn(PREVIOUS, F.lag("rate").over(s.ordered()))).select(*columns, PREVIOUS)
    ready = feature_frame(rows, cfg, remove_outliers).where(NEW)
    previous = F.col(PREVIOUS if mode in RETURN_MODES else "rate")
    scored = score_features(ready, run, model)
    return with_uncertainty(scored, run, model, mode, previous).drop("pred", PREVIOUS, NEW)


def with_uncertainty(scored: DataFrame, run: Run, model: str, mode: str, previous: Column) -> DataFrame:
    """``predicted_rate`` and, if the run has intervals, ``uncertainty``, both as rates."""
    scored = scored.withColumn("predicted_rate", prep.to_rate(mode, F.col("pred"), previous))
    if run.widths is None:
        return scored
    widths = run.widths.where(F.col("model") == model).withColumnRenamed("model", "_model")
    rows = intervals.attach(scored.withColumn("_model", F.lit(model)), widths, ("_model",), out="_half")
    high, low = (prep.to_rate(mode, F.col("pred") + side * F.col("_half"), previous) for side in (1, -1))
    return rows.withColumn("uncertainty", (high - low) / 2).drop("_model", "_half")


def project(df: DataFrame, digits: int = DIGITS) -> DataFrame:
    """Response rows: date text, key, rounded rate and, when known, spread."""
    columns = [
        F.date_format("date", "yyyy-MM-dd").alias("date"),
        F.col("key"),
        F.round("predicted_rate", digits).alias("predicted_rate"),
    ]
    spread = F.round("uncertainty", digits) if "uncertainty" in df.columns else F.lit(None).cast("double")
    return df.select(*columns, spread.alias("uncertainty"))


def model_info(run: Run, model: str = STACKING) -> DataFrame:
    """One row about a model of a run."""
    choose(run, model)
    keys = run.robust.agg(F.count_distinct("key").alias("n_keys"))
    return keys.select(
        F.lit(model).alias("model_name"),
        F.lit(run.base).alias("run_path"),
        F.lit(run.run_id).alias("run_id"),
        F.lit(", ".join(run.available)).alias("models"),
        F.col("n_keys"),
    )
