import datetime
import time

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from ratepanel.operators import features
from ratepanel.operators.ema import ema
from ratepanel.plans import panels, score, train
from ratepanel.plans.catalog import scoring
from ratepanel.sources.sinks import RunStore
from ratepanel.streaming.bars import bars_stream
from ratepanel.streaming.ema import continue_ema, ema_stream
from ratepanel.streaming.score import score_stream
from ratepanel.streaming.state import BatchTable
from ratepanel.streaming.stateful import ema_states, use_state_store, with_past

CFG = train.TrainConfig(
    features=features.config(
        {
            "moving_averages": {"sma_windows": [3], "ema_windows": [3]},
            "macd": {"enabled": False},
            "rsi": {"enabled": False},
            "stoch_rsi": {"enabled": False},
            "bollinger_bands": {"enabled": False},
            "lags": {"periods": [1, 2]},
            "cross_currency": {"enabled": False},
            "target": {"mode": "n_step_ahead"},
        }
    ),
    presets=("linear", "forest"),
    overrides={"forest": {"numTrees": 2, "maxDepth": 3}},
    validation=False,
)


@pytest.fixture(scope="module")
def run(spark, sf, tmp_path_factory):
    store = RunStore(spark, str(tmp_path_factory.mktemp("runs")))
    table = train.train_run(panels.panel_orders(spark, sf), store, "run_a", CFG)
    assert sorted(r["model"] for r in table.collect()) == ["forest", "linear", "stacking"]
    return score.load_run(store)


def test_every_model_scores_every_row_with_history(spark, sf, run):
    panel = panels.panel_orders(spark, sf)
    want = features.drop_warm_up(features.add_features(panel, CFG.features)).count()
    for name in run.available:
        out = score.score_batch(panel, run, name)
        assert out.count() == want and out.where("predicted_rate IS NULL OR uncertainty IS NULL OR uncertainty <= 0").count() == 0
    with pytest.raises(ValueError):
        score.score_batch(panel, run, "net")


def test_stacking_combines_base_predictions(spark, sf, run):
    panel = panels.panel_orders(spark, sf)
    parts = {n: score.score_batch(panel, run, n).withColumnRenamed("predicted_rate", n) for n in run.available}
    both = parts["linear"].join(parts["forest"].drop("rate"), ["key", "date"]).join(parts["stacking"].drop("rate"), ["key", "date"])
    # the target range maps scaled predictions to rates by one straight line
    low, high = run.target_range.select("low", "high").first()
    unscale = lambda c: (F.col(c) - low) / (high - low)
    mixed = F.lit(run.meta.intercept)
    for c, w in zip(run.meta.columns, run.meta.weights):
        mixed = mixed + unscale(c) * w
    worst = both.select(F.max(F.abs(mixed - unscale("stacking")))).first()[0]
    assert worst < 1e-9


def test_short_requests_use_history(spark, sf, run):
    panel = panels.panel_orders(spark, sf)
    last = panel.groupBy("key").agg(F.max("date").alias("date"))
    request = panel.join(last, ["key", "date"]).withColumn("input_pos", F.monotonically_increasing_id())
    alone = score.score_batch(request, run, "linear")
    assert alone.count() == 0
    out = score.score_batch(request, run, "linear", history=panel)
    full = {(r["key"], r["date"]): r["predicted_rate"] for r in score.score_batch(panel, run, "linear").collect()}
    rows = out.collect()
    assert len(rows) == request.count()
    for r in rows:
        assert r["predicted_rate"] == pytest.approx(full[(r["key"], r["date"])])


def test_response_rows_and_model_info(spark, run):
    rows = [("EUR", datetime.date(2024, 1, 2), 1.23456789, None)]
    df = spark.createDataFrame(rows, "key string, date date, predicted_rate double, uncertainty double")
    assert score.project(df).first().asDict() == {
        "date": "2024-01-02", "key": "EUR", "predicted_rate": 1.234568, "uncertainty": None,
    }
    info = score.model_info(run, "linear").first()
    assert info["n_keys"] == 5 and info["run_id"] == "run_a"


def write_parts(df, base, parts):
    """One file per part, so that a stream sees them one after the other."""
    for i, part in enumerate(parts):
        df.where(part).coalesce(1).write.mode("append").parquet(f"{base}/in")


def test_stream_scoring_equals_batch(spark, sf, run, tmp_path):
    panel = panels.panel_orders(spark, sf)
    write_parts(panel, tmp_path, ["date < '1997-01-01'", "date >= '1997-01-01' AND date < '1999-01-01'", "date >= '1999-01-01'"])
    stream = spark.readStream.schema("key string, date date, rate double").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    sink = BatchTable(f"{tmp_path}/out")
    writer = score_stream(stream, run, BatchTable(f"{tmp_path}/late"), sink, f"{tmp_path}/check", "linear")
    writer.trigger(availableNow=True).start().awaitTermination()
    got = sink.read_all(spark, "date string, key string, predicted_rate double, uncertainty double").toPandas()
    want = score.project(score.score_batch(panel, run, "linear")).toPandas()
    both = got.merge(want, on=["key", "date"], suffixes=("", "_want"))
    assert len(got) == len(want) == len(both)
    np.testing.assert_allclose(both["predicted_rate"], both["predicted_rate_want"], atol=2e-6)


def test_stream_ema_continues_over_batches(spark, sf, tmp_path):
    panel = panels.panel_orders(spark, sf)
    write_parts(panel, tmp_path, ["date < '1996-06-01'", "date >= '1996-06-01' AND date < '2000-01-01'", "date >= '2000-01-01'"])
    stream = spark.readStream.schema("key string, date date, rate double").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    sink = BatchTable(f"{tmp_path}/out")
    spans = {"e5": 5, "e26": 26}
    writer = ema_stream(stream, spans, sink, BatchTable(f"{tmp_path}/late"), f"{tmp_path}/check")
    writer.trigger(availableNow=True).start().awaitTermination()
    got = sink.read_all(spark, "key string, date date, rate double, e5 double, e26 double").toPandas()
    want = ema(panel, "rate", spans).toPandas()
    both = got.merge(want, on=["key", "date"], suffixes=("", "_want"))
    assert len(got) == len(want) == len(both)
    for c in spans:
        np.testing.assert_allclose(both[c], both[f"{c}_want"], rtol=1e-9)


def test_stopped_averages_go_on_and_late_rows_are_kept(spark, panel, tmp_path):
    df = panel({"A": [1.0, 2, 4, 8, 16, 32], "B": [5.0, 3, 1, 2, 9, 7], "C": [1.0, 1, 1, 1, 1, 1]})
    spans = {"e2": 2, "e9": 9}
    sink, late = BatchTable(f"{tmp_path}/out"), BatchTable(f"{tmp_path}/late")

    def arrive(rows):
        rows.coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = spark.readStream.schema("key string, date date, rate double").parquet(f"{tmp_path}/in")
        ema_stream(stream, spans, sink, late, f"{tmp_path}/check").trigger(availableNow=True).start().awaitTermination()

    arrive(df.where("date <= '2022-01-02'"))
    arrive(df.where("date BETWEEN '2022-01-03' AND '2022-01-04' AND key <> 'C'"))
    arrive(df.where("date >= '2022-01-04' AND key <> 'C'"))
    arrive(df.where("key = 'C' AND date > '2022-01-02'").unionByName(df.where("key = 'A' AND date = '2022-01-01'")))
    got = sink.read_all(spark, "key string, date date, rate double, e2 double, e9 double").toPandas()
    want = ema(df, "rate", spans).toPandas()
    both = got.merge(want, on=["key", "date"], suffixes=("", "_want"))
    assert len(got) == len(want) == len(both) == 18
    for c in spans:
        np.testing.assert_allclose(both[c], both[f"{c}_want"], rtol=1e-12)
    dropped = late.read_all(spark, "key string, date date, rate double").collect()
    assert sorted((r["key"], r["date"].day) for r in dropped) == [("A", 1), ("A", 4), ("B", 4)]
    # a batch writes only the keys it brings
    assert {r["key"] for r in spark.read.parquet(sink.folder(3)).collect()} == {"C"}


def test_idle_keys_are_forgotten(spark, panel, tmp_path):
    df = panel({"A": [1.0, 2, 4, 8], "B": [5.0, 3, 1, 2]})

    def arrive(rows):
        rows.coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = spark.readStream.schema("key string, date date, rate double").parquet(f"{tmp_path}/in")
        use_state_store(spark)
        states = ema_states(stream, {"e": 3}, idle=datetime.timedelta(seconds=1))
        out = states.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/check")
        # timers keep a query that takes what is available from ending
        running = out.trigger(processingTime="1 second").start()
        for _ in range(60):
            time.sleep(0.5)
            if sum(p["numInputRows"] for p in running.recentProgress):
                break
        running.stop()

    arrive(df.where("date <= '2022-01-02'"))
    time.sleep(2)
    # the batch that brings B wakes A's timer
    arrive(df.where("key = 'B' AND date = '2022-01-03'"))
    arrive(df.where("key = 'A' AND date > '2022-01-02'"))
    found = {(r["key"], r["date"].day): r["e"] for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    assert found[("A", 2)] == 1.5 and found[("A", 3)] == 4.0 and found[("A", 4)] == 6.0


def test_past_rows_come_with_new_ones(spark, panel, tmp_path):
    df = panel({"A": [1.0, 2, 4, 8, 16], "B": [5.0, 3, 1, 2, 9]})
    use_state_store(spark)
    for i, part in enumerate(("date <= '2022-01-03'", "date = '2022-01-04' AND key = 'A'", "date >= '2022-01-04'")):
        df.where(part).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = spark.readStream.schema("key string, date date, rate double").parquet(f"{tmp_path}/in")
        out = BatchTable(f"{tmp_path}/out{i}")
        writer = with_past(stream, 2).writeStream.foreachBatch(lambda b, n, out=out: out.write(b, n))
        writer.option("checkpointLocation", f"{tmp_path}/check").trigger(availableNow=True).start().awaitTermination()
    schema = "key string, date date, rate double, kind string"
    found = sorted((r["key"], r["kind"], r["rate"]) for r in BatchTable(f"{tmp_path}/out2").read_all(spark, schema).collect())
    assert found == [("A", "late", 8.0), ("A", "new", 16.0), ("A", "past", 4.0), ("A", "past", 8.0)] + [
        ("B", "new", 2.0), ("B", "new", 9.0), ("B", "past", 1.0), ("B", "past", 3.0)
    ]


def test_state_has_a_store_for_each_core(spark, panel, tmp_path):
    """However many partitions shuffles have; the tasks of a batch's scoring do not grow with them either."""
    df = panel({"A": [1.0, 2, 4, 8, 16], "B": [5.0, 3, 1, 2, 9]})
    df.coalesce(1).write.parquet(f"{tmp_path}/in")
    usual = spark.conf.get("spark.sql.shuffle.partitions")
    use_state_store(spark)
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "24")
        stream = spark.readStream.schema("key string, date date, rate double").parquet(f"{tmp_path}/in")
        writer = with_past(stream, 2).writeStream.format("parquet").option("path", f"{tmp_path}/out")
        scoring.run_all(spark, writer.option("checkpointLocation", f"{tmp_path}/check"))
        assert spark.conf.get("spark.sql.shuffle.partitions") == "24"
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", usual)
    assert len(list((tmp_path / "check/state/0").glob("[0-9]*"))) == spark.sparkContext.defaultParallelism == 8
    assert spark.read.parquet(f"{tmp_path}/out").count() == 10


def test_ema_state_drops_rows_already_counted(spark, panel):
    df = panel({"A": [1, 2, 3, 4]})
    empty = spark.createDataFrame([], "key string, last_date date, e double")
    _, state = continue_ema(df.where("date < '2022-01-03'"), empty, {"e": 5})
    out, new = continue_ema(df, state, {"e": 5})
    assert out.count() == 2
    want = pd.Series([1.0, 2, 3, 4]).ewm(span=5, adjust=False).mean().iloc[-1]
    assert new.first()["e"] == pytest.approx(want)


def test_stream_bars_wait_for_the_watermark(spark, tmp_path):
    t = lambda h, m: datetime.datetime(2024, 1, 1, h, m)
    rows = [("a", t(0, 5), 1.0), ("a", t(0, 50), 2.0), ("a", t(3, 0), 9.0)]
    spark.createDataFrame(rows, "key string, ts timestamp, value double").coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("key string, ts timestamp, value double").parquet(f"{tmp_path}/in")
    writer = bars_stream(stream).writeStream.format("parquet").option("path", f"{tmp_path}/out")
    writer.option("checkpointLocation", f"{tmp_path}/check").trigger(availableNow=True).start().awaitTermination()
    out = spark.read.parquet(f"{tmp_path}/out").collect()
    assert [(r["open"], r["close"], r["volume"]) for r in out] == [(1.0, 2.0, 2)]


def test_return_targets_come_back_as_rates(spark, panel, tmp_path):
    rng = np.random.default_rng(4)
    walk = lambda start: start * np.exp(rng.normal(0.001, 0.01, 60).cumsum())
    df = panel({"A": walk(1.0), "B": walk(150.0)})
    cfg = features.config({**CFG.features, "target": {"mode": "log_return"}})
    store = RunStore(spark, str(tmp_path / "runs"))
    train.train_run(df, store, "run_r", train.TrainConfig(cfg, presets=("linear",), validation=False, remove_outliers=False))
    out = score.score_batch(df, score.load_run(store), "linear").toPandas().sort_values(["key", "date"])
    # the return of the row itself is a function of the features, so rates come back closely
    for key, scale in (("A", 1.0), ("B", 150.0)):
        part = out[out["key"] == key]
        assert len(part) == 58
        np.testing.assert_allclose(part["predicted_rate"], part["rate"], atol=0.05 * scale)
