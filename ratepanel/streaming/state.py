"""State tables for micro-batches.

A state table has one folder per batch under the shared folder. A batch that is
run again after a failure writes the same folder again, so state and output
stay consistent without locks.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession


@dataclass(frozen=True)
class BatchTable:
    path: str

    def folder(self, batch: int) -> str:
        return f"{self.path}/batch={batch}"

    def write(self, df: DataFrame, batch: int) -> None:
        df.write.mode("overwrite").parquet(self.folder(batch))

    def read(self, spark: SparkSession, batch: int, schema: str) -> DataFrame:
        """The table as a batch left it; empty before the first batch."""
        if batch < 0:
            return spark.createDataFrame([], schema)
        return spark.read.schema(schema).parquet(self.folder(batch))

    def read_all(self, spark: SparkSession, schema: str) -> DataFrame:
        return spark.read.schema(schema).option("recursiveFileLookup", True).parquet(self.path)
