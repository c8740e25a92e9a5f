"""Writing predictions, metrics, scaler parameters and versioned runs."""

from __future__ import annotations

import datetime
import json
from collections.abc import Mapping, Sequence
from typing import Any

from pyspark.ml import Model
from pyspark.ml.util import DefaultParamsReader
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ratepanel.operators.metrics import METRICS

# Names of the outputs of a run.
RESULTS = "model_comparison"
RANKING = "features_ranked"
LOW_IMPORTANCE = "features_low_importance"
KEY_SCALERS = "per_key_scalers"
TARGET_SCALER = "scaler_y"
CATEGORIES = "key_categories"
INTERVALS = "intervals"
RUN_ID_FORMAT = "run_%Y%m%d_%H%M%S"


def write(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "overwrite", partition_by: Sequence[str] = ()) -> None:
    writer = df.write.mode(mode).format(fmt)
    if fmt == "csv":
        writer = writer.option("header", True)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.save(path)


def write_predictions(df: DataFrame, path: str, fmt: str = "csv", **options: Any) -> None:
    """Date, key, rate when known, predicted rate, uncertainty when known."""
    columns = [c for c in ("date", "key", "rate", "predicted_rate", "uncertainty") if c in df.columns]
    write(df.select(*columns), path, fmt, **options)


def write_results(metrics: DataFrame, base: str, fmt: str = "csv") -> None:
    write(metrics, f"{base}/{RESULTS}", fmt)


def write_ranking(ranking: DataFrame, low: DataFrame, base: str) -> None:
    write(ranking, f"{base}/{RANKING}", "csv")
    write(low.select("feature"), f"{base}/{LOW_IMPORTANCE}", "csv")


def save_params(params: DataFrame, base: str, name: str = KEY_SCALERS) -> None:
    write(params, f"{base}/{name}")


def load_params(spark: SparkSession, base: str, name: str = KEY_SCALERS) -> DataFrame:
    return spark.read.parquet(f"{base}/{name}")


# --- versioned runs ---------------------------------------------------------


def make_run_id(now: datetime.datetime | None = None) -> str:
    return (now or datetime.datetime.now()).strftime(RUN_ID_FORMAT)


class RunStore:
    """Runs under one base path: ``<base>/<run_id>/...``.

    The newest finished run is a row in ``<base>/runs``, written last, so a
    reader never sees a half-written run as the latest.
    """

    def __init__(self, spark: SparkSession, base: str) -> None:
        self.spark = spark
        self.base = base.rstrip("/")

    def path(self, run_id: str) -> str:
        return f"{self.base}/{run_id}"

    def save_model(self, model: Model, name: str, run_id: str) -> str:
        path = f"{self.path(run_id)}/models/{name}"
        model.write().overwrite().save(path)
        return path

    def load_model(self, name: str, run_id: str) -> Model:
        return DefaultParamsReader.loadParamsInstance(f"{self.path(run_id)}/models/{name}", self.spark.sparkContext)

    def log_metrics(self, run_id: str, metrics: DataFrame, names: Sequence[str] = METRICS) -> None:
        """Write (model, metric, value) as the run's partition; a run logged again replaces its rows."""
        rows = metric_rows(metrics, names, ids=("model",))
        write(rows, f"{self.base}/metrics/run_id={run_id}")

    def write_manifest(self, run_id: str, metadata: Mapping[str, Any]) -> None:
        rows = [(run_id, name, json.dumps(value, default=str)) for name, value in metadata.items()]
        table = self.spark.createDataFrame(rows, "run_id string, name string, value string").coalesce(1)
        write(table, f"{self.path(run_id)}/manifest")

    def manifest(self, run_id: str) -> dict[str, Any]:
        rows = self.spark.read.parquet(f"{self.path(run_id)}/manifest").collect()
        return {r["name"]: json.loads(r["value"]) for r in rows}

    def publish(self, run_id: str, when: datetime.datetime | None = None) -> None:
        when = when or datetime.datetime.now()
        row = self.spark.createDataFrame([(run_id, when)], "run_id string, finished timestamp").coalesce(1)
        write(row, f"{self.base}/runs", mode="append")

    def latest(self) -> str:
        runs = self.spark.read.parquet(f"{self.base}/runs")
        found = runs.agg(F.max_by("run_id", F.struct("finished", "run_id"))).first()[0]
        if found is None:
            raise FileNotFoundError(f"no finished run under {self.base}")
        return found


def metric_rows(metrics: DataFrame, names: Sequence[str] = METRICS, ids: Sequence[str] = ("run_id", "model")) -> DataFrame:
    """One row per metric from one column per metric."""
    each = F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in names])
    return metrics.select(*ids, F.inline(each))


def manifest_json(df: DataFrame, names: Sequence[str], ids: Sequence[str] = ("run_id",)) -> DataFrame:
    """One JSON document per run from its columns."""
    return df.select(*ids, F.to_json(F.struct(*ids, *names)).alias("manifest"))
