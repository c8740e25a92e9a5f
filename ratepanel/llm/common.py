"""Helpers the operators share: bounded chunks of a batch, identities, dropping rows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WORD = r"[^\x20\x09-\x0D]+"
CHUNK_BYTES = 8_000_000


def remainder(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id as text, modulo ``modulus``; -1 without an id."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % F.lit(modulus), F.lit(-1)).cast("int")


def byte_texts(column: pa.Array) -> Iterator[bytes]:
    """UTF-8 of each text, empty for null. ``bytes.split()`` and ``bytes.lower()``
    then work on the six ASCII white-space bytes and on A-Z alone."""
    for value in column.cast(pa.large_binary()):
        yield value.as_py() or b""


def chunks(batch: pa.RecordBatch, text: str = "text", limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Cuts a batch into runs of rows of about ``limit`` text bytes, one row at least."""
    lengths = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False)
    ends = np.cumsum(lengths.astype(np.int64))
    start = 0
    while start < batch.num_rows:
        before = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, before + limit, side="right")))
        yield batch.slice(start, stop - start)
        start = stop


def unused(df: DataFrame, name: str) -> str:
    """A column name that ``df`` does not have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"{name}_"
    return name


def text_key(text: str = "text") -> Column:
    return F.xxhash64(F.col(text))


def identified(docs: DataFrame, *more: Column) -> DataFrame:
    """``doc_id, text_hash`` tell rows apart; rows equal in both are repeats of one document."""
    return docs.select(F.col("doc_id"), text_key().alias("text_hash"), *more)


def without(docs: DataFrame, losers: DataFrame, how: str = "left_anti") -> DataFrame:
    """Documents whose identity is not (``left_semi``: is) in ``losers``."""
    keys = losers.select(F.col("doc_id").alias("_loser_id"), F.col("text_hash").alias("_loser_hash"))
    same = docs["doc_id"].eqNullSafe(keys["_loser_id"]) & (F.xxhash64(docs["text"]) == keys["_loser_hash"])
    return docs.join(keys, same, how)
