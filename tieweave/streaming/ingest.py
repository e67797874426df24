"""Continuous loading of landed files into the raw layer.

The build itself is a batch. A stream only appends new assertions, each once: repeated
ids within the watermark are dropped, and a batch that is run again after a failure
writes to a folder of its own number, which replaces what it wrote before.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from .. import schemas


def landed(spark: SparkSession, path: str, schema: str = schemas.ASSERTIONS + ", loaded_at timestamp") -> DataFrame:
    """Assertions as they land in ``path`` as JSON lines."""
    return spark.readStream.schema(schema).json(path)


def once(stream: DataFrame, late: str = "7 days") -> DataFrame:
    return stream.withWatermark("loaded_at", late).dropDuplicatesWithinWatermark(["assertion_id"])


def into(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Writes each batch to ``path`` below its number and stops when all that has landed is in."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
