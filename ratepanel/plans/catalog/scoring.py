"""Batch scoring and streams."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from ratepanel.operators import features
from ratepanel.operators.stack import Ridge
from ratepanel.plans import panels, score, train
from ratepanel.plans.catalog.inputs import scratch
from ratepanel.plans.catalog.registry import BASE, BASE_KEY, base_rows, ema_sql, query, rounded, rs, with_sql
from ratepanel.session import settle
from ratepanel.sources.sinks import RunStore
from ratepanel.streaming.bars import bars_stream
from ratepanel.streaming.ema import ema_stream
from ratepanel.streaming.score import score_stream
from ratepanel.streaming.state import BatchTable
from ratepanel.streaming.stateful import stores_by_core

# a run small enough for checks; the defaults are the full configuration
SMALL = train.TrainConfig(
    features=features.config(
        {
            "moving_averages": {"sma_windows": [5, 20], "ema_windows": [12]},
            "cross_currency": {"base_currency": BASE_KEY, "index_size": 3},
            "target": {"mode": "n_step_ahead"},
        }
    ),
    presets=("linear", "boosted_b"),
    overrides={"boosted_b": {"maxIter": 2, "maxDepth": 3}},
    validation=False,
)


_STORES: dict[tuple[str, str], RunStore] = {}


def trained_run(spark: SparkSession, sf: str) -> score.Run:
    """The newest run on these tables; trained by the first query that asks."""
    place = (spark.sparkContext.applicationId, sf)
    if place not in _STORES:
        store = RunStore(spark, scratch(spark, "run"))
        train.train_run(panels.panel_orders(spark, sf), store, "run_20240101_120000", SMALL)
        _STORES[place] = store
    return score.load_run(_STORES[place])


@query("i1_batch_scoring")
def i1(spark: SparkSession, sf: str) -> DataFrame:
    return score.score_batch(panels.panel_orders(spark, sf), trained_run(spark, sf), "linear")


@query("i2_model_choice")
def i2(spark: SparkSession, sf: str) -> DataFrame:
    """Predictions of every model of the run by name."""
    run = trained_run(spark, sf)
    panel = panels.panel_orders(spark, sf)
    parts = [score.score_batch(panel, run, m).withColumn("model", F.lit(m)) for m in run.available]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out.groupBy("model").agg(F.count(F.lit(1)).alias("n"), F.avg("predicted_rate").alias("mean_rate"))


@query("i3_stacked_scoring")
def i3(spark: SparkSession, sf: str) -> DataFrame:
    return score.score_batch(panels.panel_orders(spark, sf), trained_run(spark, sf), score.STACKING)


@query(
    "i4_response_rows",
    with_sql(BASE)
    + """SELECT strftime(date, '%Y-%m-%d') AS date, key, round(0.6 * SMA_5 + 0.4 * EMA_12, 6) AS predicted_rate,
    round(abs(SMA_5 - EMA_12), 6) AS uncertainty FROM placed""",
)
def i4(spark: SparkSession, sf: str) -> DataFrame:
    meta = Ridge(("SMA_5", "EMA_12"), (0.6, 0.4), 0.0)
    rows = meta.predict(base_rows(spark, sf), "predicted_rate")
    return score.project(rows.withColumn("uncertainty", F.abs(F.col("SMA_5") - F.col("EMA_12"))))


@query("i5_model_info")
def i5(spark: SparkSession, sf: str) -> DataFrame:
    return score.model_info(trained_run(spark, sf)).drop("run_path")


def event_stream(spark: SparkSession, sf: str) -> DataFrame:
    """The event table as a stream of its files."""
    schema = panels.table(spark, sf, "events").schema
    files = spark.readStream.schema(schema).option("pathGlobFilter", "events*.parquet").parquet(sf)
    return files.select(F.col("event_type").alias("key"), F.col("ts").cast("timestamp").alias("ts"), "value")


def run_all(spark: SparkSession, writer: DataStreamWriter) -> None:
    """All that has arrived, with state divided over the cores."""
    with stores_by_core(spark):
        running = writer.trigger(availableNow=True).start()
    running.awaitTermination()


@query("i6_stream_scoring")
def i6(spark: SparkSession, sf: str) -> DataFrame:
    """Orders arrive in order, in files of one range of dates each, and are scored on arrival."""
    run = trained_run(spark, sf)
    base = scratch(spark, "stream")
    # a stream reads files by age, so each half is written after the one before it
    panel = settle(panels.panel_orders(spark, sf))
    middle = panel.agg(F.expr("percentile_approx(date, 0.5)").alias("middle")).first()["middle"]
    for part in (F.col("date") <= middle, F.col("date") > middle):
        panel.where(part).repartition("key").write.mode("append").parquet(f"{base}/in/{uuid.uuid4().hex}")
        stream = spark.readStream.schema("key string, date date, rate double").parquet(f"{base}/in/*")
        sink = BatchTable(f"{base}/out")
        # the second run goes on from the first one's checkpoint
        run_all(spark, score_stream(stream, run, BatchTable(f"{base}/late"), sink, f"{base}/check", "linear"))
    return sink.read_all(spark, "date string, key string, predicted_rate double, uncertainty double")


@query(
    "i7_stream_bars",
    """WITH bars AS (
      SELECT event_type AS key, date_trunc('hour', ts) AS date, arg_min(value, (ts, value)) AS open, max(value) AS high,
        min(value) AS low, arg_max(value, (ts, value)) AS close, count(value) AS volume
      FROM events GROUP BY 1, 2
    ) SELECT * FROM bars WHERE date + INTERVAL 1 HOUR <= (SELECT max(ts) - INTERVAL 1 HOUR FROM events)""",
)
def i7(spark: SparkSession, sf: str) -> DataFrame:
    """Hourly bars of all windows the watermark has closed."""
    base = scratch(spark, "stream")
    out = bars_stream(event_stream(spark, sf))
    run_all(spark, out.writeStream.format("parquet").option("path", f"{base}/out").option("checkpointLocation", f"{base}/check"))
    back = spark.read.parquet(f"{base}/out")
    return back.withColumn("date", F.col("date").cast("timestamp_ntz"))


@query(
    "i8_stream_ema",
    with_sql(
        "points AS (SELECT event_type AS key, ts AS date, avg(value) AS rate FROM events GROUP BY 1, 2)",
        ema_sql("points", "rate", {"EMA_5": 5, "EMA_26": 26}),
    )
    + f"SELECT key, date, {rs(['rate', 'EMA_5', 'EMA_26'])} FROM ema",
)
def i8(spark: SparkSession, sf: str) -> DataFrame:
    base = scratch(spark, "stream")
    sink = BatchTable(f"{base}/out")
    stream = event_stream(spark, sf).withColumnsRenamed({"ts": "date", "value": "rate"})
    spans = {"EMA_5": 5, "EMA_26": 26}
    run_all(spark, ema_stream(stream, spans, sink, BatchTable(f"{base}/late"), f"{base}/check"))
    out = sink.read_all(spark, "key string, date timestamp, rate double, EMA_5 double, EMA_26 double")
    return rounded(out.withColumn("date", F.col("date").cast("timestamp_ntz")))
