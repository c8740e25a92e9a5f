"""Scoring a stream of rates with a saved run."""

from __future__ import annotations

import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from ratepanel.operators.features import look_back
from ratepanel.plans.score import STACKING, Run, project, score_batch
from ratepanel.streaming.state import BatchTable
from ratepanel.streaming.stateful import use_state_store, with_past


def score_stream(
    stream: DataFrame,
    run: Run,
    late: BatchTable,
    sink: BatchTable,
    checkpoint: str,
    model: str = STACKING,
    idle: datetime.timedelta | None = None,
) -> DataStreamWriter:
    """A stream writer that scores (key, date, rate) rows batch by batch.

    Spark's state store keeps, per key, as many rates as a feature can look back; a batch
    touches the keys it brings. Rows at or before the newest date of their key go to ``late``.

    A batch is written beside the checkpoint, in place of the one before it, and scored from there in the session
    of ``stream``: a stream's own session has no adaptive execution, so every shuffle would have a task a partition.
    """
    spark = stream.sparkSession
    use_state_store(spark)
    arrived = f"{checkpoint.rstrip('/')}-arrived"
    need = look_back(run.manifest["features"]) + 1

    def step(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(arrived)
        batch = spark.read.schema(batch.schema).parquet(arrived)
        rows = {kind: batch.where(F.col("kind") == kind).drop("kind") for kind in ("new", "past", "late")}
        sink.write(project(score_batch(rows["new"], run, model, rows["past"])), batch_id)
        late.write(rows["late"], batch_id)

    return with_past(stream, need, idle=idle).writeStream.foreachBatch(step).option("checkpointLocation", checkpoint)
