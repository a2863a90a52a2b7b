"""Named Parquet tables of a data folder, read through Spark only (the folder may be in any Hadoop store)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """The table ``name`` of ``folder``; columns are pruned by whoever selects from it."""
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def register_views(spark: SparkSession, folder: str, names: tuple[str, ...] = TABLES) -> None:
    """Make the tables known to ``spark.sql`` under their own names."""
    for name in names:
        table(spark, folder, name).createOrReplaceTempView(name)
