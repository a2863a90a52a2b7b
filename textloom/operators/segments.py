"""Scans over the rows of a key in order (running sums, maxima, last values) that no key's rows need meet for.

A window over a key puts all its rows into one task; here a key may hold a third of the table. Rows are dealt by ranges
of (key, order) and cut into pieces of at most 2**PIECE_BITS rows. A piece is scanned by itself, and summed up in one row;
sums of the pieces before it are found the same way, 2**FAN_BITS pieces at a time and in as many levels as the longest
key needs, and carried into the piece.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources import work

PIECE_BITS, FAN_BITS = 14, 10
#: kind of scan: what two neighbouring pieces make together; both may be null.
TOGETHER = {
    "sum": lambda a, b: F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0)),
    "max": lambda a, b: F.greatest(a, b),
    "last": lambda a, b: F.coalesce(b, a),
}


def _over(how: str, value: Column, window) -> Column:  # noqa: ANN001
    return {"sum": F.sum, "max": F.max}[how](value).over(window) if how != "last" else F.last(value, True).over(window)


def _summed(how: str, value: str, order: str) -> Column:
    return {"sum": F.sum, "max": F.max}[how](value) if how != "last" else F.max_by(value, F.when(F.col(value).isNotNull(), F.col(order)))


def scans(df: DataFrame, key: str, order: list[str], values: dict[str, tuple[Column, str]], *, reverse: bool = False, exclusive: bool = False) -> DataFrame:
    """``df`` with a column for each of ``values`` (name: column, kind): its scan over the key's rows up to this one.

    Kinds are ``sum``, ``max`` and ``last`` (the last value that isn't null); reverse: from the key's end; exclusive:
    without this row. Rows of equal order come in the order of all columns. Null is a key of its own.
    """
    spark = df.sparkSession
    columns = df.columns
    ties = [c for c, kind in df.dtypes if c not in (key, *order) and not kind.startswith(("map", "variant"))]
    turn = (lambda c: F.col(c).desc()) if reverse else (lambda c: F.col(c).asc())
    by = [F.col(key).asc(), *map(turn, order), *map(turn, ties)]
    rows = df.select("*", *(c.alias(f"_{n}") for n, (c, _) in values.items())).repartitionByRange(*by).sortWithinPartitions(*by)
    path = work.folder(spark, "scan")
    rows.withColumn("_at", F.monotonically_increasing_id()).write.parquet(path)
    rows = spark.read.parquet(path).withColumn("_piece", F.shiftright("_at", PIECE_BITS))
    kinds = {f"_{n}": how for n, (_, how) in values.items()}

    pieces = rows.groupBy(key, F.col("_piece").alias("_at")).agg(*(_summed(how, n, "_at").alias(n) for n, how in kinds.items()))
    before = _before(pieces, key, kinds).select(F.col(key).alias("_key"), F.col("_at").alias("_of"), *(F.col(n).alias(f"{n}_before") for n in kinds))
    last = -1 if exclusive else 0
    inside = Window.partitionBy(key, "_piece").orderBy("_at").rowsBetween(Window.unboundedPreceding, last)
    joined = rows.join(before, (F.col("_piece") == F.col("_of")) & F.col(key).eqNullSafe(F.col("_key")), "left")
    return joined.select(*columns, *(TOGETHER[how](F.col(f"{n}_before"), _over(how, F.col(n), inside)).alias(n[1:]) for n, how in kinds.items()))


def _before(pieces: DataFrame, key: str, kinds: dict[str, str]) -> DataFrame:
    """key, _at and what the key's pieces before each come to."""
    most = pieces.groupBy(key).agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
    if most <= 1 << FAN_BITS:
        upto = Window.partitionBy(key).orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
        return pieces.select(key, "_at", *(_over(how, F.col(n), upto).alias(n) for n, how in kinds.items()))
    pieces = pieces.withColumn("_up", F.shiftright("_at", FAN_BITS))
    above = pieces.groupBy(key, "_up").agg(*(_summed(how, n, "_at").alias(n) for n, how in kinds.items())).withColumnRenamed("_up", "_at")
    above = _before(above, key, kinds).select(F.col(key).alias("_key"), F.col("_at").alias("_of"), *(F.col(n).alias(f"{n}_above") for n in kinds))
    upto = Window.partitionBy(key, "_up").orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
    pieces = pieces.select(key, "_at", "_up", *(_over(how, F.col(n), upto).alias(n) for n, how in kinds.items()))
    joined = pieces.join(above, (F.col("_up") == F.col("_of")) & F.col(key).eqNullSafe(F.col("_key")), "left")
    return joined.select(key, "_at", *(TOGETHER[how](F.col(f"{n}_above"), F.col(n)).alias(n) for n, how in kinds.items()))
