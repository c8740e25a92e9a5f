"""What a task holds, and results that faster paths must not change."""

import datetime
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from ratepanel.plans import panels
from ratepanel.plans.catalog.registry import rounded
from ratepanel.streaming import stateful
from ratepanel.streaming.stateful import ema_states, use_state_store


@pytest.mark.parametrize("copies", [1, 6])
def test_rounding_equals_round(spark, copies):
    rng = np.random.default_rng(3)
    values = [None, math.nan, math.inf, -math.inf, 0.0, -0.0, -1e-9, 5e-7, 1.0000005, -2.5000005, 0.1234565, 1e5, 123456789.1234565, 1e300]
    values += [float(x) for x in np.r_[rng.normal(0, 3, 2000), rng.integers(-9999, 9999, 2000) / 2e6, 10.0 ** rng.uniform(-9, 15, 2000)]]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, x0 double")
    df = df.select("i", *[(F.col("x0") * (k + 1)).alias(f"x{k}") for k in range(copies)])
    both = rounded(df).alias("a").join(df.alias("b"), "i")
    for k in range(copies):
        want = F.round(f"b.x{k}", 6)
        assert both.where(~F.col(f"a.x{k}").eqNullSafe(want)).count() == 0
        assert both.where(F.col(f"a.x{k}").cast("string") == "-0.0").count() == 0


def test_supplier_rows_of_a_task_are_bounded(spark, tmp_path, monkeypatch):
    rows = spark.range(4000).selectExpr("id % 500 AS l_suppkey", "1.0D + id AS l_extendedprice", "timestamp_ntz '1995-01-01 00:00:00' + make_dt_interval(CAST(id % 9 AS INT)) AS l_shipdate")
    rows.write.parquet(f"{tmp_path}/lineitem.parquet")
    monkeypatch.setattr(panels, "ROWS_PER_TASK", 100)
    panel = panels.panel_supplier(spark, str(tmp_path))
    sizes = [r["n"] for r in panel.groupBy(F.spark_partition_id()).agg(F.count(F.lit(1)).alias("n")).collect()]
    assert len(sizes) > 20 and max(sizes) <= 400 and sum(sizes) == 4000


class Box:
    def __init__(self):
        self.held = None

    def exists(self):
        return self.held is not None

    def get(self):
        return self.held

    def update(self, value):
        self.held = value


def test_long_batches_leave_in_pieces(monkeypatch):
    monkeypatch.setattr(stateful, "PIECE", 100, raising=False)
    step = stateful._Averages({"e": 5}, "key", "date", "rate", None)
    step.newest, step.averages = Box(), Box()
    rng = np.random.default_rng(5)
    at = pd.Timestamp("2024-01-01") + pd.to_timedelta(rng.permutation(1000), unit="s")
    rows = pd.DataFrame({"key": "A", "date": at, "rate": rng.normal(5, 1, 1000)})
    rows = pd.concat([rows, rows.head(50).assign(rate=1.0)], ignore_index=True)
    out = list(step.handleInputRows(("A",), (rows.iloc[i : i + 70] for i in range(0, len(rows), 70)), None))
    assert max(map(len, out)) <= 100
    got, means = pd.concat(out), rows.groupby("date")["rate"].mean()
    assert list(got["date"]) == list(means.index) and not got["late"].any()
    np.testing.assert_allclose(got["e"].astype(float), means.ewm(span=5, adjust=False).mean(), rtol=1e-12)
    later = pd.DataFrame({"key": "A", "date": [at.max(), at.max() + pd.Timedelta(seconds=5)], "rate": [9.0, 2.0]})
    late, new = step.handleInputRows(("A",), iter([later]), None)
    assert late["late"].all() and late["e"].isna().all() and not new["late"].any()
    assert new["e"].iloc[0] == pytest.approx(means.ewm(span=5, adjust=False).mean().iloc[-1] * 2 / 3 + 2.0 / 3)


def test_batches_longer_than_a_piece_keep_keys_apart(spark, tmp_path):
    use_state_store(spark)
    n = 70_000
    rows = spark.range(2 * n).selectExpr("IF(id % 2 = 0, 'A', 'B') AS key", "timestamp_seconds(CAST(id / 2 AS BIGINT)) AS date", "CAST(id % 7 AS DOUBLE) AS rate")
    rows.write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(rows.schema).parquet(f"{tmp_path}/in")
    states = ema_states(stream, {"e": 5})
    out = states.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/check")
    out.trigger(availableNow=True).start().awaitTermination()
    got = spark.read.parquet(f"{tmp_path}/out").toPandas().sort_values(["key", "date"])
    for k in ("A", "B"):
        own = got[got["key"] == k]
        assert len(own) == n and not own["late"].any()
        np.testing.assert_allclose(own["e"], own["rate"].ewm(span=5, adjust=False).mean(), rtol=1e-9)


def test_calendar_dates_stay_dates():
    days = pd.DataFrame({"date": [datetime.date(2024, 1, 3), datetime.date(2024, 1, 2), None], "rate": [1.0, 2.0, 3.0]})
    micros, values, calendar = stateful._by_date(iter([days]), "date", "rate")
    assert list(stateful._dates(micros, calendar)) == [datetime.date(2024, 1, 2), datetime.date(2024, 1, 3)] and list(values) == [2.0, 1.0]
