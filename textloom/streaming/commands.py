"""Command events as a stream: the batch function applied to a ``readStream``; no state, so no watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming.query import StreamingQuery

from ..operators.commands import condensed

SCHEMA = "event_id long, command string, output string"


def read_events(spark: SparkSession, folder: str, schema: str = SCHEMA, file_format: str = "parquet") -> DataFrame:
    """Events from files that arrive in ``folder``."""
    return spark.readStream.schema(schema).format(file_format).load(folder)


def write_condensed(events: DataFrame, folder: str, checkpoint: str, *, strict: bool = False, once: bool = False) -> StreamingQuery:
    """Condensed events appended to ``folder``; ``once``: what is there now, then stop."""
    out = condensed(events, strict).writeStream.format("parquet").option("path", folder).option("checkpointLocation", checkpoint).outputMode("append")
    return out.trigger(availableNow=True).start() if once else out.start()


def savings(events: DataFrame) -> DataFrame:
    """Characters saved by route, of condensed events (a table, or a stream in complete mode)."""
    from pyspark.sql import functions as F

    return condensed(events).groupBy("route").agg(F.sum("saved").alias("saved"), F.count("*").alias("events"))
