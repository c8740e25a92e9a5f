"""Exponential averages over a stream, one state per key."""

from __future__ import annotations

import datetime
from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from ratepanel.operators.ema import ema_columns, memory, number_rows
from ratepanel.operators.layout import open_series
from ratepanel.streaming.state import BatchTable
from ratepanel.streaming.stateful import ema_states, use_state_store


def continue_ema(
    rows: DataFrame, state: DataFrame, spans: Mapping[str, int], key: str = "key", date: str = "date", value: str = "rate"
) -> tuple[DataFrame, DataFrame]:
    """Averages of new rows that go on from ``state``, and the new state.

    Rows at or before the last date of their key have been counted already and
    are dropped.
    """
    halo = max(memory(span) for span in spans.values())
    before = state.select(key, F.col("last_date"), *[F.col(n).alias(f"_seed_{n}") for n in spans])
    fresh = rows.select(key, date, value).join(before, key, "left")
    fresh = fresh.where(F.col("last_date").isNull() | (F.col(date) > F.col("last_date"))).drop("last_date")
    s, laid = open_series(fresh, halo, key, date)
    laid = ema_columns(number_rows(laid, s), s, value, spans, seeds={n: f"_seed_{n}" for n in spans})
    out = s.close(laid).select(key, date, value, *spans)
    newest = out.groupBy(key).agg(F.max(date).alias("last_date"), *[F.max_by(n, date).alias(n) for n in spans])
    kept = state.join(newest.select(key), key, "left_anti").select(newest.columns)
    return out, newest.unionByName(kept)


def ema_stream(
    stream: DataFrame,
    spans: Mapping[str, int],
    sink: BatchTable,
    late: BatchTable,
    checkpoint: str,
    key: str = "key",
    date: str = "date",
    value: str = "rate",
    idle: datetime.timedelta | None = None,
) -> DataStreamWriter:
    """A stream writer that appends (key, date, value, averages) to ``sink``.

    The state of a key is in Spark's state store. Rows at or before the newest date of their key
    were counted already; they go to ``late``.
    """
    use_state_store(stream.sparkSession)

    def step(batch: DataFrame, batch_id: int) -> None:
        batch = batch.persist()
        sink.write(batch.where("NOT late").drop("late"), batch_id)
        late.write(batch.where("late").select(key, date, value), batch_id)
        batch.unpersist()

    states = ema_states(stream, spans, key, date, value, idle)
    return states.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint)
