"""Split series give what whole series give; ranks are gapless."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from ratepanel.operators import layout, prep
from ratepanel.operators.features import add_features, config
from ratepanel.sources.bars import fill_gaps

EVERYTHING = config({"atr": {"enabled": True}, "obv": {"enabled": True}, "lags": {"fill_method": "bfill"}})


def as_pandas(df):
    return df.toPandas().sort_values(["key", "date"]).reset_index(drop=True)


def test_hot_key_split_equals_whole(hourly):
    df, _ = hourly
    whole = as_pandas(add_features(df, EVERYTHING, rows_per_block=10**9))
    split = as_pandas(add_features(df, EVERYTHING, rows_per_block=900))
    assert list(whole.columns) == list(split.columns)
    for c in whole.columns[3:]:
        np.testing.assert_allclose(
            split[c].astype(float), whole[c].astype(float), rtol=1e-9, atol=1e-7, equal_nan=True, err_msg=c
        )


def test_blocks_bound_the_window_groups(hourly):
    df, _ = hourly
    halo = 100
    s, laid = layout.open_series(df, halo, rows_per_block=500)
    assert s.split
    sizes = laid.groupBy("key", layout.BLOCK).agg(F.count("*").alias("n"), F.count_if(layout.OWN).alias("own"))
    rows = {(r["key"], r[layout.BLOCK]): (r["n"], r["own"]) for r in sizes.collect()}
    assert max(n for n, _ in rows.values()) <= 500 + halo + 60
    assert sum(own for _, own in rows.values()) == 3040
    # the small key is not cut
    assert [k for k in rows if k[0] == "B"] == [("B", 0)]


def test_calendar_panels_stay_whole(panel):
    s, _ = layout.open_series(panel({"A": [1, 2, 3]}), 5)
    assert not s.split


def test_timestamps_are_split_by_default(hourly):
    s, _ = layout.open_series(hourly[0], 5)
    assert s.split


def test_fill_forward_crosses_blocks(hourly, spark):
    _, pdf = hourly
    pdf = pdf[["key", "date", "rate"]].sort_values(["key", "date"]).reset_index(drop=True)
    # values only every 700th row, and none at the head
    pdf["rate"] = pdf["rate"].where(pdf.index % 700 == 300)
    df = spark.createDataFrame(pdf, "key string, date timestamp_ntz, rate double").withColumn(
        "rate", F.when(~F.isnan("rate"), F.col("rate"))
    )
    expected = pdf.groupby("key")["rate"].transform(lambda x: x.ffill().bfill())
    for rows in (200, 10**9):
        out = as_pandas(fill_gaps(df, ["rate"], key="key", rows_per_block=rows))
        np.testing.assert_allclose(out["rate"].astype(float), expected, equal_nan=True)


def test_position_is_gapless_with_one_hot_key(hourly):
    df, pdf = hourly
    out = as_pandas(layout.with_position(df.repartition(7), in_key="at"))
    assert list(out["pos"]) == list(range(len(pdf)))
    assert list(out["at"]) == list(out.groupby("key").cumcount())


def test_lead_on_split_series(hourly):
    df, pdf = hourly
    out = as_pandas(prep.add_target(df, "n_step_ahead", 3, keep_null=True, rows_per_block=200))
    expected = pdf.sort_values(["key", "date"]).groupby("key")["rate"].shift(-3)
    np.testing.assert_allclose(out["target"].astype(float), expected, equal_nan=True)


@pytest.mark.parametrize("rows_per_block", [37, 10**6])
def test_sequences_in_blocks(hourly, rows_per_block):
    df, pdf = hourly
    steps = 5
    out = as_pandas(prep.sequences(df, ["rate"], steps, "rate", cross_key=True, rows_per_block=rows_per_block))
    rates = pdf.sort_values(["key", "date"])["rate"].to_numpy()
    assert len(out) == len(rates) - steps
    x = np.array([[row[0] for row in window] for window in out["x"]])
    np.testing.assert_allclose(x, np.lib.stride_tricks.sliding_window_view(rates, steps)[:-1])
    np.testing.assert_allclose(out["y"], rates[steps:])
