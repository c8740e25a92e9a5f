"""State per key in Spark's state store, and what runs on it.

Every key keeps its own state in the RocksDB store of its partition: the newest date and the averages
there (``ema_states``), or the rates that features can look back on (``with_past``). A batch reads and writes
only the keys it brings; Spark's checkpoint holds the rest, and a stopped
query goes on from it. A key that stays away for longer than ``idle`` is forgotten by a timer;
such a query needs a trigger by time, for with timers Spark never finds all input done.

Rows of one key and date within a batch are averaged, as the batch operators
do. A row whose date is not after the newest one of its key is *late*: its date was answered in an earlier
batch. Late rows leave marked, for a table of their own, and change no state.

A batch's rows of a key meet in one task; the trigger's limits bound a batch.

Every partition of state opens a store and a Python worker, even for a batch that brings it nothing. Streams
started within ``stores_by_core`` have one for each core, however many partitions shuffles of tables have.
"""

from __future__ import annotations

import datetime
from collections.abc import Iterator, Mapping, Sequence
from contextlib import contextmanager
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
PARTITIONS = "spark.sql.shuffle.partitions"
ROCKS_DB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


# Rows of a key that leave at a time.
PIECE = 65_536


def use_state_store(spark: SparkSession) -> None:
    """Streams started from now on keep their state in RocksDB."""
    spark.conf.set(PROVIDER, ROCKS_DB)


@contextmanager
def stores_by_core(spark: SparkSession) -> Iterator[None]:
    """Streams first started inside divide their state over the cluster's cores, if shuffles have more partitions.

    A stream keeps the number it was first started with, in its checkpoint.
    """
    usual = spark.conf.get(PARTITIONS)
    spark.conf.set(PARTITIONS, str(min(int(usual), spark.sparkContext.defaultParallelism)))
    try:
        yield
    finally:
        spark.conf.set(PARTITIONS, usual)


def _by_date(rows: Iterator[pd.DataFrame], date: str, value: str) -> tuple[np.ndarray, np.ndarray, bool]:
    """The microseconds of the dates in order, the mean value of each, and whether they are calendar dates.

    Of every piece of rows only two numbers a row are kept.
    """
    micros, values, days = [np.zeros(0, np.int64)], [np.zeros(0)], False
    for piece in rows:
        piece = piece[[date, value]].dropna()
        if len(piece):
            days = isinstance(piece[date].iloc[0], datetime.date) and not isinstance(piece[date].iloc[0], datetime.datetime)
            at = piece[date].to_numpy(dtype="datetime64[D]" if days else "datetime64[us]")
            micros.append(at.astype("datetime64[us]").astype(np.int64))
            values.append(piece[value].to_numpy(dtype=np.float64, copy=True))
    at = np.concatenate(micros)
    micros.clear()
    sums = np.concatenate(values)
    values.clear()
    order = np.argsort(at, kind="stable")
    at, sums = at[order], sums[order]
    first = np.flatnonzero(np.r_[True, at[1:] != at[:-1]][: len(at)])
    if len(first) < len(at):
        sums = pd.Series(sums).groupby(np.repeat(np.arange(len(first)), np.diff(np.r_[first, len(at)]))).mean().to_numpy()
        at = at[first]
    return at, sums, days


def _dates(micros: np.ndarray, days: bool) -> np.ndarray:
    """What ``_by_date`` read as the values of a date column."""
    at = micros.astype("datetime64[us]")
    return at.astype("datetime64[D]").astype(object) if days else at.astype("datetime64[ns]")


def _pieces(late: int, n: int) -> Iterator[tuple[int, int]]:
    """Cuts the late rows, which come first, and the others into runs of at most ``PIECE``."""
    for start, stop in ((0, late), (late, n)):
        for at in range(start, stop, PIECE):
            yield at, min(stop, at + PIECE)


class _Kept(StatefulProcessor):
    """A processor that forgets a key after ``idle`` without rows."""

    def __init__(self, key: str, date: str, value: str, idle: datetime.timedelta | None) -> None:
        self.key, self.date, self.value, self.idle = key, date, value, idle

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.newest = handle.getValueState("newest", T.StructType([T.StructField("newest", T.LongType())]))

    def _wait(self, timers: Any) -> None:
        """One timer a key, ``idle`` after the batch."""
        if self.idle is None:
            return
        for old in list(self.handle.listTimers()):
            self.handle.deleteTimer(old[0] if isinstance(old, (tuple, list)) else old)
        self.handle.registerTimer(timers.getCurrentProcessingTimeInMs() + int(self.idle.total_seconds() * 1000))

    def _last(self) -> int | None:
        return self.newest.get()[0] if self.newest.exists() else None

    def close(self) -> None:
        pass


class _Averages(_Kept):
    def __init__(self, spans: Mapping[str, int], *names: Any) -> None:
        super().__init__(*names)
        self.spans = dict(spans)

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        fields = [T.StructField(f"average_{i}", T.DoubleType()) for i in range(len(self.spans))]
        self.averages = handle.getValueState("averages", T.StructType(fields))

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        micros, values, days = _by_date(rows, self.date, self.value)
        last = self._last()
        late = int(np.searchsorted(micros, last, side="right")) if last is not None else 0
        averages = list(self.averages.get()) if last is not None else [None] * len(self.spans)
        for start, stop in _pieces(late, len(micros)):
            out = pd.DataFrame({self.key: [key[0]] * (stop - start), self.date: _dates(micros[start:stop], days)})
            out[self.value] = values[start:stop]
            for i, (name, span) in enumerate(self.spans.items()):
                out[name] = np.nan
                if start >= late:
                    seed = [] if averages[i] is None else [averages[i]]
                    found = pd.Series(np.r_[seed, values[start:stop]]).ewm(span=span, adjust=False).mean().to_numpy()
                    out[name] = found[len(seed) :]
                    averages[i] = float(found[-1])
            out["late"] = start < late
            yield out.astype({n: object for n in self.spans}).where(out.notna(), None)
        if late < len(micros):
            self.newest.update((int(micros[-1]),))
            self.averages.update(tuple(averages))
        self._wait(timerValues)

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        self.newest.clear()
        self.averages.clear()
        return iter([])


class _Past(_Kept):
    def __init__(self, need: int, *names: Any) -> None:
        super().__init__(*names)
        self.need = need

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        fields = [T.StructField("at", T.LongType()), T.StructField("rate", T.DoubleType())]
        self.past = handle.getListState("past", T.StructType(fields))

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        micros, values, days = _by_date(rows, self.date, self.value)
        last = self._last()
        late = int(np.searchsorted(micros, last, side="right")) if last is not None else 0
        known = [(int(r[0]), float(r[1])) for r in self.past.get()] if last is not None else []
        if known and late < len(micros):
            yield self._rows(key, np.array([k[0] for k in known]), np.array([k[1] for k in known]), days, "past")
        for start, stop in _pieces(late, len(micros)):
            yield self._rows(key, micros[start:stop], values[start:stop], days, "late" if start < late else "new")
        if late < len(micros):
            fresh = slice(max(late, len(micros) - self.need), None)
            known += [(int(m), float(v)) for m, v in zip(micros[fresh], values[fresh])]
            self.past.put(known[-self.need :])
            self.newest.update((known[-1][0],))
        self._wait(timerValues)

    def _rows(self, key: Any, micros: np.ndarray, values: np.ndarray, days: bool, kind: str) -> pd.DataFrame:
        return pd.DataFrame({self.key: [key[0]] * len(micros), self.date: _dates(micros, days), self.value: values, "kind": kind})

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        self.newest.clear()
        self.past.clear()
        return iter([])


def _transformed(stream: DataFrame, processor: _Kept, more: Sequence[T.StructField]) -> DataFrame:
    names = (processor.key, processor.date)
    fields = [stream.schema[n] for n in names] + [T.StructField(processor.value, T.DoubleType())]
    grouped = stream.select(*names, processor.value).groupBy(processor.key)
    mode = "None" if processor.idle is None else "ProcessingTime"
    return grouped.transformWithStateInPandas(processor, T.StructType([*fields, *more]), "Append", mode)


def ema_states(
    stream: DataFrame,
    spans: Mapping[str, int],
    key: str = "key",
    date: str = "date",
    value: str = "rate",
    idle: datetime.timedelta | None = None,
) -> DataFrame:
    """(key, date, value, averages, late) of every new date; averages of late rows are null."""
    more = [T.StructField(n, T.DoubleType()) for n in spans] + [T.StructField("late", T.BooleanType())]
    return _transformed(stream, _Averages(spans, key, date, value, idle), more)


def with_past(
    stream: DataFrame,
    need: int,
    key: str = "key",
    date: str = "date",
    value: str = "rate",
    idle: datetime.timedelta | None = None,
) -> DataFrame:
    """(key, date, value, kind): new rows, the ``need`` rows before them as ``past``, and late ones."""
    return _transformed(stream, _Past(need, key, date, value, idle), [T.StructField("kind", T.StringType())])
