"""Selection finds the exact quantiles."""

import numpy as np
import pandas as pd
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from ratepanel.operators.quantiles import largest_group, quantiles, select_quantiles

PROBS = {"lo": 0.0, "q1": 0.25, "q2": 0.5, "q3": 0.75, "hi": 1.0}


def expected(values):
    return {n: np.quantile(values, p) for n, p in PROBS.items()}


def wanted(column="x"):
    return {n: (column, p) for n, p in PROBS.items()}


@pytest.mark.parametrize("shape", ["normal", "ties", "constant", "tail"])
def test_selection_matches_numpy(spark, shape):
    rng = np.random.default_rng(3)
    n = 5000
    values = {
        "normal": rng.normal(0, 10, n),
        "ties": rng.integers(0, 4, n).astype(float),
        "constant": np.full(n, 2.5),
        "tail": np.exp(rng.normal(0, 3, n)),
    }[shape]
    pdf = pd.DataFrame({"key": np.where(np.arange(n) % 3 == 0, "hot", "cold"), "x": values})
    df = spark.createDataFrame(pdf)
    # a coarse sketch leaves wide brackets, so that ranking inside them matters
    found = select_quantiles(df, wanted(), ["key"], accuracy=50).toPandas().set_index("key")
    for key, group in pdf.groupby("key"):
        for name, value in expected(group["x"]).items():
            assert found.loc[key, name] == pytest.approx(value, rel=1e-12, abs=1e-12), (key, name)


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.floats(-1e6, 1e6), min_size=1, max_size=40))
def test_selection_on_small_groups(spark, values):
    df = spark.createDataFrame([(v,) for v in values], "x double")
    row = select_quantiles(df, wanted(), accuracy=10).first()
    for name, value in expected(values).items():
        assert row[name] == pytest.approx(value, rel=1e-9, abs=1e-9)


def test_large_groups_take_the_selection(spark):
    df = spark.range(1000).selectExpr("id % 2 AS key", "CAST(id AS double) AS x")
    assert largest_group(df, ["key"]) == 500
    small = quantiles(df, wanted(), ["key"]).orderBy("key").collect()
    large = quantiles(df, wanted(), ["key"], max_group_values=10).orderBy("key").collect()
    assert [r.asDict() for r in small] == [r.asDict() for r in large]


def test_nulls_are_skipped(spark):
    df = spark.createDataFrame([(1.0,), (None,), (3.0,), (None,)], "x double")
    assert select_quantiles(df, {"m": ("x", 0.5)}).first()["m"] == 2.0


def test_many_outputs_take_several_passes(spark):
    df = spark.range(200).selectExpr("id % 2 AS key", *[f"CAST((id * {i + 3}) % 97 AS double) AS c{i}" for i in range(5)])
    outputs = {f"{c}_{n}": (c, p) for c in [f"c{i}" for i in range(5)] for n, p in PROBS.items()}
    small = quantiles(df, outputs, ["key"]).orderBy("key").collect()
    large = quantiles(df, outputs, ["key"], max_group_values=10).orderBy("key").collect()
    assert [r.asDict() for r in small] == [r.asDict() for r in large]
    whole = quantiles(df, outputs, max_group_values=10).first().asDict()
    assert whole == quantiles(df, outputs).first().asDict()
