import os
import sys

import pandas as pd
import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from ratepanel.session import build_session  # noqa: E402

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()
SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    session = build_session("tests", 8, **{"spark.ui.showConsoleProgress": "false"})
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf():
    return SF


@pytest.fixture
def panel(spark):
    """A panel from ``{key: [rates]}``, one row per day."""

    def build(series, start="2022-01-01"):
        frames = [
            pd.DataFrame({"key": k, "date": pd.date_range(start, periods=len(v)).date, "rate": [float(x) for x in v]})
            for k, v in series.items()
        ]
        return spark.createDataFrame(pd.concat(frames), "key string, date date, rate double")

    return build


@pytest.fixture(scope="session")
def hourly(spark):
    """A timestamped panel whose key A holds most rows, and a small key B."""
    import numpy as np

    rng = np.random.default_rng(7)
    frames = []
    for key, n in (("A", 3000), ("B", 40)):
        steps = rng.integers(1, 5000, n).cumsum()
        frames.append(
            pd.DataFrame(
                {
                    "key": key,
                    "date": pd.Timestamp("2024-01-01") + pd.to_timedelta(steps, unit="s"),
                    "rate": 80 + rng.normal(0, 0.5, n).cumsum(),
                    "volume": rng.integers(1, 9, n).astype(float),
                }
            )
        )
    pdf = pd.concat(frames, ignore_index=True)
    pdf["rate"] = pdf["rate"].abs() + 1
    pdf["high"], pdf["low"], pdf["close"] = pdf["rate"] + 1, pdf["rate"] - 0.5, pdf["rate"] + 0.1
    schema = "key string, date timestamp_ntz, rate double, volume double, high double, low double, close double"
    df = spark.createDataFrame(pdf, schema).cache()
    df.count()
    return df, pdf
