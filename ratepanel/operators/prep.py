"""Targets, scaling, encoding, splits and sequence windows."""

from __future__ import annotations

import functools
from collections.abc import Sequence
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ratepanel.functions import indicators as ind
from ratepanel.operators.layout import BLOCK, OWN, is_calendar, open_series, position_blocks, with_position, with_rank
from ratepanel.operators.quantiles import MAX_GROUP_VALUES, quantiles

# Target modes.
TARGET_MODES = ("raw_rate", "log_return", "pct_change", "n_step_ahead")

SEQUENCE_BLOCK = 100_000


# --- targets ----------------------------------------------------------------


def add_target(
    df: DataFrame,
    mode: str = "raw_rate",
    n: int = 1,
    key: str = "key",
    date: str = "date",
    rate: str = "rate",
    out: str = "target",
    keep_null: bool = False,
    rows_per_block: int | None = None,
) -> DataFrame:
    """Add the target and drop rows that have none.

    ``raw_rate`` is the rate of the same row: features of that row then contain
    the target. Forecasts want ``n_step_ahead``.
    """
    if mode not in TARGET_MODES:
        raise ValueError(f"unknown target mode {mode!r}, expected one of {', '.join(TARGET_MODES)}")
    p = F.col(rate)
    if mode == "raw_rate":
        df = df.withColumn(out, p)
    elif mode == "n_step_ahead":
        # seen backwards in time, the row n steps ahead is n rows before
        df = _lead(df, n, key, date, rate, out, rows_per_block)
    else:
        s, df = open_series(df, 1, key, date, rows_per_block)
        grown = ind.growth(s, p)
        df = s.close(df.withColumn(out, F.log(grown) if mode == "log_return" else grown - 1))
    return df if keep_null else df.na.drop(subset=[out])


def _lead(
    df: DataFrame, n: int, key: str, date: str, rate: str, out: str, rows_per_block: int | None
) -> DataFrame:
    columns = df.columns
    s, laid = open_series(df, n, key, date, rows_per_block)
    w = s.ordered()
    if not s.split:
        return laid.withColumn(out, F.lead(rate, n).over(w))
    # a block has the n rows before it but not those after it, so every row
    # hands its rate to the row n steps back
    pairs = laid.withColumn("_back", F.lag(F.col(date), n).over(w)).where(F.col(OWN) & F.col("_back").isNotNull())
    ahead = pairs.select(key, F.col("_back").alias(date), F.col(rate).alias(out))
    return df.join(ahead, [key, date], "left").select(*columns, out)


# --- scaling ----------------------------------------------------------------


def fit_robust(
    df: DataFrame,
    columns: Sequence[str],
    by_key: bool = True,
    key: str = "key",
    max_group_values: int = MAX_GROUP_VALUES,
) -> DataFrame:
    """Median and interquartile range as rows (key, feature, center, scale).

    A zero range scales by 1. Without ``by_key`` the key is NULL.
    """
    by = [key] if by_key else []
    wanted = {
        f"_{i}_{q}": (c, prob) for i, c in enumerate(columns) for q, prob in (("q1", 0.25), ("q2", 0.5), ("q3", 0.75))
    }
    solved = quantiles(df, wanted, by, max_group_values)
    width = lambda i: F.col(f"_{i}_q3") - F.col(f"_{i}_q1")
    rows = F.array(
        *[
            F.struct(
                F.lit(c).alias("feature"),
                F.col(f"_{i}_q2").alias("center"),
                F.when(width(i) == 0, F.lit(1.0)).otherwise(width(i)).alias("scale"),
            )
            for i, c in enumerate(columns)
        ]
    )
    name = F.col(key) if by_key else F.lit(None).cast("string").alias(key)
    return solved.select(name, F.inline(rows))


def apply_robust(
    df: DataFrame, params: DataFrame, columns: Sequence[str], by_key: bool = True, key: str = "key"
) -> DataFrame:
    """Scale ``columns``; keys without parameters keep their raw values."""
    wide = [
        F.max(F.when(F.col("feature") == c, F.col(field))).alias(f"_{field}_{i}")
        for i, c in enumerate(columns)
        for field in ("center", "scale")
    ]
    if by_key:
        # one row per key: AQE broadcasts it when it is small
        joined = df.join(params.groupBy(key).agg(*wide), key, "left")
    else:
        joined = df.join(F.broadcast(params.agg(*wide)))
    scaled = {
        c: F.coalesce((F.col(c) - F.col(f"_center_{i}")) / F.col(f"_scale_{i}"), F.col(c).cast("double"))
        for i, c in enumerate(columns)
    }
    return joined.withColumns(scaled).select(*df.columns)


def fit_minmax(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row (feature, low, high) per column."""
    found = df.agg(*[f(c).cast("double").alias(f"_{n}_{i}") for i, c in enumerate(columns) for n, f in (("lo", F.min), ("hi", F.max))])
    rows = F.array(
        *[
            F.struct(F.lit(c).alias("feature"), F.col(f"_lo_{i}").alias("low"), F.col(f"_hi_{i}").alias("high"))
            for i, c in enumerate(columns)
        ]
    )
    return found.select(F.inline(rows))


def _with_ranges(df: DataFrame, params: DataFrame, columns: Sequence[str]) -> DataFrame:
    wide = params.agg(
        *[F.max(F.when(F.col("feature") == c, F.col(f))).alias(f"_{f}_{i}") for i, c in enumerate(columns) for f in ("low", "high")]
    )
    return df.join(F.broadcast(wide))


def apply_minmax(df: DataFrame, params: DataFrame, columns: Sequence[str]) -> DataFrame:
    """To 0..1; a column without range becomes 0."""
    joined = _with_ranges(df, params, columns)
    scaled = {}
    for i, c in enumerate(columns):
        span = F.col(f"_high_{i}") - F.col(f"_low_{i}")
        scaled[c] = (F.col(c) - F.col(f"_low_{i}")) / F.when(span == 0, F.lit(1.0)).otherwise(span)
    return joined.withColumns(scaled).select(*df.columns)


def invert_minmax(
    df: DataFrame, params: DataFrame, column: str, feature: str | None = None, out: str | None = None
) -> DataFrame:
    """Back to the units of ``feature`` (the column itself by default)."""
    joined = _with_ranges(df, params, [feature or column])
    value = F.col(column) * (F.col("_high_0") - F.col("_low_0")) + F.col("_low_0")
    out = out or column
    return joined.withColumn(out, value).select(*df.columns, *([] if out in df.columns else [out]))


def to_rate(mode: str, target: Column, previous: Column) -> Column:
    """A predicted target as a rate; returns build on the previous rate."""
    if mode == "log_return":
        return previous * F.exp(target)
    if mode == "pct_change":
        return previous * (1 + target)
    return target


# --- encoding ---------------------------------------------------------------

MAX_DENSE_CATEGORIES = 1000


def categories(df: DataFrame, key: str = "key", limit: int = MAX_DENSE_CATEGORIES) -> list[Any]:
    """Sorted keys for dense one-hot columns. More keys than ``limit`` is an
    error: use ``one_hot_vector``, which stays in the cluster."""
    found = [r[0] for r in df.select(key).distinct().orderBy(key).limit(limit + 1).collect()]
    if len(found) > limit:
        raise ValueError(f"more than {limit} categories; use one_hot_vector")
    return found


def one_hot(df: DataFrame, keys: Sequence[Any], key: str = "key", prefix: str | None = None) -> DataFrame:
    """One 0/1 column per category but the first, which is all zeros."""
    prefix = prefix or key
    flags = {f"{prefix}_{k}": F.when(F.col(key) == F.lit(k), 1).otherwise(0) for k in list(keys)[1:]}
    return df.withColumns(flags) if flags else df


def category_index(df: DataFrame, key: str = "key", out: str = "key_index") -> DataFrame:
    """Category numbers in key order, for any number of keys."""
    return with_rank(df.select(key).distinct(), [key], out)


def one_hot_vector(
    df: DataFrame, dimension: DataFrame, key: str = "key", index: str = "key_index", out: str = "key_vec"
) -> DataFrame:
    """Sparse one-hot vector without the first category.

    A key that ``dimension`` lacks gets the zero vector, like the first one.
    """
    from pyspark.ml.feature import OneHotEncoder

    # the encoder drops the last category, so number downwards
    top = dimension.agg(F.max(index).alias("_top"))
    flipped = dimension.join(F.broadcast(top)).select(key, (F.col("_top") - F.col(index)).cast("double").alias("_cat"))
    encoder = OneHotEncoder(inputCol="_cat", outputCol=out, dropLast=True).fit(flipped)
    known = df.join(flipped, key, "left").join(F.broadcast(top))
    known = known.withColumn("_cat", F.coalesce("_cat", F.col("_top").cast("double"))).drop("_top")
    return encoder.transform(known).drop("_cat")


# --- splits -----------------------------------------------------------------


def row_total(df: DataFrame, name: str = "_rows") -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias(name))


def split(
    df: DataFrame,
    ratio: float = 0.8,
    mode: str = "per_key_time",
    key: str = "key",
    date: str = "date",
    out: str = "is_train",
) -> DataFrame:
    """Mark the first ``ratio`` of rows: of all rows in (key, date) order
    (``positional``), or of each key's own history (``per_key_time``)."""
    if mode == "positional":
        placed = with_position(df, key, date, "_at").join(F.broadcast(row_total(df)))
    elif mode == "per_key_time":
        if is_calendar(df, date):
            w = Window.partitionBy(key)
            at, rows = F.row_number().over(w.orderBy(date)) - 1, F.count(F.lit(1)).over(w)
            placed = df.withColumns({"_at": at, "_rows": rows})
        else:
            sizes = df.groupBy(key).agg(F.count(F.lit(1)).alias("_rows"))
            placed = with_position(df, key, date, "_pos", in_key="_at").join(sizes, key)
    else:
        raise ValueError(f"unknown split mode {mode!r}, expected positional or per_key_time")
    return placed.withColumn(out, F.col("_at") < F.floor(F.col("_rows") * F.lit(ratio))).select(*df.columns, out)


# --- sequences --------------------------------------------------------------


def sequences(
    df: DataFrame,
    columns: Sequence[str],
    steps: int = 15,
    label: str = "target",
    cross_key: bool = False,
    key: str = "key",
    date: str = "date",
    rows_per_block: int | None = None,
) -> DataFrame:
    """The ``steps`` feature rows before each row as ``x``, its label as ``y``.

    Windows stay inside a key; ``cross_key`` lets them run over key boundaries
    in (key, date) order.
    """
    row = F.array(*[F.col(c).cast("double") for c in columns])
    if cross_key:
        placed = with_position(df, key, date, "_pos")
        laid = position_blocks(placed, "_pos", steps, rows_per_block or SEQUENCE_BLOCK)
        w = Window.partitionBy(BLOCK).orderBy("_pos")
        own = F.col(OWN)
    else:
        s, laid = open_series(df, steps, key, date, rows_per_block)
        w, own = s.ordered(), s.own()
    seen = laid.select(
        key,
        date,
        F.col(label).alias("y"),
        own.alias("_mine"),
        F.collect_list(row).over(w.rowsBetween(-steps, -1)).alias("x"),
    )
    return seen.where(F.col("_mine") & (F.size("x") == steps)).select(key, date, "x", "y")


def flatten_sequence(df: DataFrame, steps: int, width: int, x: str = "x", out: str = "features") -> DataFrame:
    """A window as one vector, for regressors on flat features."""
    from pyspark.ml.functions import array_to_vector

    return df.where(F.size(F.flatten(x)) == steps * width).withColumn(out, array_to_vector(F.flatten(x)))


# --- row order --------------------------------------------------------------


def restore_order(df: DataFrame, position: str = "input_pos") -> DataFrame:
    """Rows in the order in which they came in; for sinks."""
    return df.orderBy(position)


def all_known(columns: Sequence[str]) -> Column:
    return functools.reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in columns])
