"""The training run: panel in, versioned run out."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ratepanel.operators import features, intervals, metrics, models, prep, stack
from ratepanel.operators.clean import iqr_filter
from ratepanel.operators.cross import add_cross
from ratepanel.operators.layout import with_position
from ratepanel.session import settle
from ratepanel.sources.sinks import CATEGORIES, INTERVALS, KEY_SCALERS, TARGET_SCALER, RunStore, save_params, write_results

KEYS = ("key", "date", "rate", "target")
KEY_VECTOR = "key_vec"


@dataclass
class TrainConfig:
    features: Mapping[str, Any] = field(default_factory=features.config)
    test_ratio: float = 0.2
    # positional cuts the (key, date) order, per_key_time each key's history
    split_mode: str = "per_key_time"
    # share of later rows that the interval around a prediction holds
    interval_level: float = intervals.LEVEL
    # parameters from training rows only; "all" also looks at test rows
    fit_on: str = "train"
    presets: Sequence[str] = ("boosted_a", "boosted_b")
    overrides: Mapping[str, Mapping[str, Any]] = field(default_factory=dict)
    meta: str = "ridge"
    meta_ratio: float = 0.5
    validation: bool = True
    remove_outliers: bool = True


def feature_frame(panel: DataFrame, cfg: Mapping[str, Any], remove_outliers: bool = True) -> DataFrame:
    """Clean panel with all features; warm-up rows are gone.

    Cross features come first: they join on narrow rows, and the wide feature
    rows are then not shuffled again.
    """
    if remove_outliers:
        panel = iqr_filter(panel)
    df = features.add_features(add_cross(panel, cfg["cross_currency"]), cfg)
    return features.drop_warm_up(df, [c for c in df.columns if c not in panel.columns])


def feature_columns(df: DataFrame) -> list[str]:
    return [c for c in df.columns if c not in KEYS and not c.startswith("_")]


@dataclass
class Prepared:
    rows: DataFrame
    columns: list[str]
    scaled: list[str]
    keys: DataFrame
    robust: DataFrame
    target_range: DataFrame


def prepare(panel: DataFrame, cfg: TrainConfig) -> Prepared:
    """Features, target, scaling, encoding and split in one settled frame."""
    target = cfg.features["target"]
    # the panel and the feature frame are each read several times
    df = settle(feature_frame(settle(panel), cfg.features, cfg.remove_outliers))
    df = prep.add_target(df, target["mode"], target["n_steps_ahead"])
    df = prep.split(df, 1 - cfg.test_ratio, cfg.split_mode)
    scaled = [c for c in feature_columns(df) if c != "is_train"]
    seen = df.where("is_train") if cfg.fit_on == "train" else df
    robust = prep.fit_robust(seen, scaled)
    target_range = prep.fit_minmax(seen, ["target"])
    keys = prep.category_index(df)
    rows = prep.apply_robust(df, robust, scaled).withColumn("y_true", F.col("target"))
    rows = prep.apply_minmax(prep.one_hot_vector(rows, keys), target_range, ["target"])
    columns = [*scaled, KEY_VECTOR]
    rows = models.assemble(rows, columns).select("key", "date", "rate", "y_true", "target", "is_train", "features")
    return Prepared(rows, columns, scaled, keys, robust, target_range)


def train_run(panel: DataFrame, store: RunStore, run_id: str, cfg: TrainConfig | None = None) -> DataFrame:
    """Train the base models and the meta model, save the run, return metrics."""
    cfg = cfg or TrainConfig()
    ready = prepare(panel, cfg)
    rows = settle(ready.rows)
    fit_rows = rows.where("is_train")
    if cfg.validation:
        fit_rows = settle(models.mark_validation(fit_rows))
    test = settle(with_position(rows.where(~F.col("is_train"))))
    meta = test
    for name in cfg.presets:
        estimator = models.preset(name, cfg.overrides.get(name))
        model = models.train(fit_rows, estimator, "is_val" if cfg.validation else None)
        store.save_model(model, name, run_id)
        meta = model.transform(meta).withColumnRenamed("pred", name)
    meta = settle(meta.drop("features"))
    n = meta.count()
    half = F.col("pos") < int(n * cfg.meta_ratio)
    mae = None
    if cfg.meta == "weighted":
        long = models.baseline_predictions(meta.where(half), ["pos"], "target", cfg.presets)
        mae = long.groupBy("model").agg(F.avg(F.abs(F.col("y") - F.col("pred"))).alias("mae"))
    learner = stack.fit_meta(meta.where(half), cfg.presets, cfg.meta, "target", mae=mae)

    scored = {name: meta.withColumn("pred", F.col(name)) for name in cfg.presets}
    scored["stacking"] = learner.predict(meta.where(~half))
    parts = []
    for name, part in scored.items():
        part = prep.invert_minmax(part, ready.target_range, "pred", "target")
        parts.append(part.select("pos", "key", F.lit(name).alias("model"), F.col("y_true").alias("y"), "pred"))
    long = parts[0]
    for part in parts[1:]:
        long = long.unionByName(part)
    long = settle(long)
    table = settle(metrics.compare(long))

    base = store.path(run_id)
    save_params(ready.robust, base, KEY_SCALERS)
    save_params(ready.target_range, base, TARGET_SCALER)
    save_params(ready.keys, base, CATEGORIES)
    save_params(intervals.calibrate(long, cfg.interval_level), base, INTERVALS)
    write_results(table, base)
    store.log_metrics(run_id, table)
    store.write_manifest(
        run_id,
        {
            "columns": ready.columns,
            "scaled": ready.scaled,
            "presets": list(cfg.presets),
            "features": cfg.features,
            "interval_level": cfg.interval_level,
            "meta": {"columns": learner.columns, "weights": learner.weights, "intercept": learner.intercept},
        },
    )
    store.publish(run_id)
    return table
