import datetime

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from ratepanel.functions.dates import parse_mixed_date
from ratepanel.operators import clean
from ratepanel.sources import bars, rates, sinks, symbols


def kept(df, key):
    return sorted(r["rate"] for r in df.where(F.col("key") == key).collect())


@pytest.mark.parametrize("limit", [10**6, 10])
def test_outliers_go_and_keys_are_apart(panel, limit):
    df = panel({"USD": list(range(1, 51)), "EUR": [*range(1, 51), 99_999]})
    out = clean.iqr_filter(df, max_group_values=limit)
    assert kept(out, "USD") == list(range(1, 51))
    assert kept(out, "EUR") == list(range(1, 51))
    report = {r["key"]: (r["kept"], r["dropped"]) for r in clean.iqr_report(df).collect()}
    assert report == {"USD": (50, 0), "EUR": (50, 1)}


def test_fences_are_inclusive(panel):
    # hinges 2 and 4, fences -1 and 7
    assert kept(clean.iqr_filter(panel({"A": [-1, 2, 3, 4, 7]})), "A") == [-1, 2, 3, 4, 7]


def test_order_of_output(panel):
    out = clean.in_order(panel({"B": range(10, 0, -1), "A": [1]})).collect()
    assert [(r["key"], r["date"]) for r in out] == sorted((r["key"], r["date"]) for r in out)


@pytest.mark.parametrize(
    "text, want",
    [
        ("2024-03-04", (2024, 3, 4)),
        ("2024-03-04 10:00:00", (2024, 3, 4)),
        ("04/03/2024", (2024, 3, 4)),
        ("3-4-2024", (2024, 4, 3)),
        ("12/25/2024", (2024, 12, 25)),
        ("4 Mar 2024", (2024, 3, 4)),
        ("March 4, 2024", (2024, 3, 4)),
        ("20240304", (2024, 3, 4)),
        ("soon", None),
    ],
)
def test_mixed_dates(spark, text, want):
    got = spark.createDataFrame([(text,)], "t string").select(parse_mixed_date("t").alias("d")).first()["d"]
    assert got == (datetime.date(*want) if want else None)


@pytest.mark.parametrize("fmt", rates.FORMATS)
def test_read_rates(spark, tmp_path, fmt):
    rows = [("01/02/2024", "EUR", "Euro", 1.1), ("2024-02-01", "EUR", "Euro", 1.3), ("05/02/2024", "JPY", "Yen", None)]
    df = spark.createDataFrame(rows, "date string, currency_code string, currency string, exchange_rate double")
    sinks.write(df, str(tmp_path / "in"), fmt)
    out = rates.read_rates(spark, str(tmp_path / "in"), fmt).collect()
    # both EUR rows are the first of February; the JPY row has no rate
    assert [(r["key"], r["date"], round(r["rate"], 9)) for r in out] == [("EUR", datetime.date(2024, 2, 1), 1.2)]


def test_missing_columns_raise(spark):
    df = spark.createDataFrame([(1.0, 2.0)], "open double, high double")
    with pytest.raises(ValueError, match="currency_code"):
        rates.standard_columns(df)
    with pytest.raises(ValueError):
        rates.read_rates(spark, "nowhere", "xml")


def test_rows_are_split_with_a_reason(spark):
    rows = [("A", "2024-01-01", 1.0), (None, "2024-01-01", 1.0), ("A", None, 1.0), ("A", "2024-01-02", None), ("A", "2024-01-03", 0.0)]
    df = spark.createDataFrame(rows, "key string, date string, rate double")
    good, bad = rates.split_valid(df)
    assert good.count() == 1
    assert sorted(r["reason"] for r in bad.collect()) == ["missing date", "missing key", "missing rate", "rate not positive"]


def test_labels_fall_back_to_the_symbol(spark):
    df = spark.createDataFrame([("GC=F",), ("XYZ",)], "symbol string")
    out = {r["symbol"]: r["label"] for r in symbols.label(df, symbols.market_labels(spark)).collect()}
    assert out == {"GC=F": "Gold", "XYZ": "XYZ"}
    assert len(symbols.LABELS) == 58


def test_bars_and_wide_table(spark):
    t = lambda h, m: datetime.datetime(2024, 1, 1, h, m)
    rows = [("a", t(0, 1), 5.0), ("a", t(0, 9), 7.0), ("a", t(0, 5), 3.0), ("b", t(1, 0), 1.0)]
    hourly = bars.bars(spark.createDataFrame(rows, "key string, ts timestamp, value double"), "hour")
    a = hourly.where("key = 'a'").first()
    assert (a["open"], a["high"], a["low"], a["close"], a["volume"]) == (5.0, 7.0, 3.0, 7.0, 3)
    wide = bars.align_wide(hourly, ["a", "b"], ["open", "close"])
    assert wide.columns == ["date", "a_open", "a_close", "b_open", "b_close"]
    assert bars.close_only(wide).columns == ["date", "a_close", "b_close"]
    filled = bars.fill_gaps(wide, wide.columns[1:]).orderBy("date").collect()
    assert [(r["a_close"], r["b_close"]) for r in filled] == [(7.0, 1.0), (7.0, 1.0)]


def test_run_store(spark, tmp_path, panel):
    store = sinks.RunStore(spark, str(tmp_path / "runs"))
    with pytest.raises(Exception):
        store.latest()
    for i in (1, 2):
        run = sinks.make_run_id(datetime.datetime(2024, 1, i))
        store.write_manifest(run, {"n": i, "names": ["x"]})
        store.publish(run, datetime.datetime(2024, 1, i))
    assert store.latest() == "run_20240102_000000"
    assert store.manifest("run_20240101_000000") == {"n": 1, "names": ["x"]}


def test_latest_and_tail(panel):
    df = panel({"A": [1, 2, 3], "B": [9]})
    assert {r["key"]: r["rate"] for r in bars.latest_per_key(df).collect()} == {"A": 3.0, "B": 9.0}
    assert sorted(r["rate"] for r in bars.tail_per_key(df, 2).collect()) == [2.0, 3.0, 9.0]


def test_load_summary(panel):
    row = rates.load_summary(panel({"A": [1, 2], "B": [3]})).first()
    assert (row["n_rows"], row["n_keys"]) == (3, 2)
    assert np.isclose(pd.Series([1.0]).mean(), 1.0)


def test_metrics_logged_twice_are_there_once(spark, tmp_path):
    store = sinks.RunStore(spark, str(tmp_path))
    table = spark.createDataFrame([("a", 1.0, 2.0), ("b", 3.0, 4.0)], "model string, MAE double, MSE double")
    for run in ("run_20240101_120000", "run_20240102_120000", "run_20240101_120000"):
        store.log_metrics(run, table, ("MAE", "MSE"))
    rows = spark.read.parquet(f"{tmp_path}/metrics").collect()
    assert len(rows) == 8 and {r["run_id"] for r in rows} == {"run_20240101_120000", "run_20240102_120000"}
