"""Cancellation: jobs that are begun under a tag can be ended by it, from any thread."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import SparkSession


@contextmanager
def cancellable(spark: SparkSession, tag: str) -> Iterator[None]:
    """Jobs begun inside, by this thread, carry ``tag`` (without a comma)."""
    spark.sparkContext.addJobTag(tag)
    try:
        yield
    finally:
        spark.sparkContext.removeJobTag(tag)


def cancel(spark: SparkSession, tag: str) -> None:
    """End the running jobs of ``tag``, whose actions then raise. The session's own tags are known to one thread only."""
    spark.sparkContext.cancelJobsWithTag(tag)
