"""What the operators share: staged tables, stand-in keys for null ids, and Arrow batch helpers."""

from __future__ import annotations

import atexit
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Stands in for a null document id wherever an id is needed as a key.
NULL_ID = -(2**63)
#: Used only where the session names no folder (tests, one machine).
LOCAL_SHARED = "/tmp/textloom-shared"
#: Word separators of the contracts: space and \t to \r.
SPACES = " \t\n\x0b\x0c\r"

#: Rows in an Arrow batch at most: whole texts in a batch of the default size could be large.
BATCH_ROWS = 1000
_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"

_staged: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``; on one machine a local one will do."""
    if named := spark.conf.get("spark.checkpoint.dir", None):
        return named
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return LOCAL_SHARED


def stage(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and reread it: lineage is cut, and a lost executor costs nothing.

    The files go with ``release``, or when the session ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/textloom/{spark.sparkContext.applicationId}/{label}-{uuid.uuid4().hex}"
    if not _staged:
        atexit.register(drop_staged)
    _staged.append((spark, path))
    small_batches(spark)
    df.write.option("compression", "zstd").parquet(path)
    found = spark.read.schema(df.schema).parquet(path)
    found._staged_at = path
    return found


def small_batches(spark: SparkSession) -> None:
    """Hold the session's Arrow batches at BATCH_ROWS rows, also for results that run after their operator has returned."""
    if not 0 < int(spark.conf.get(_ROWS)) <= BATCH_ROWS:
        spark.conf.set(_ROWS, str(BATCH_ROWS))


def staged_so_far() -> int:
    """A mark for ``release``."""
    return len(_staged)


def release(mark: int, *kept: DataFrame) -> None:
    """Remove the tables staged since ``mark`` but for ``kept``, once nothing else reads them."""
    stay = {df._staged_at for df in kept}
    for spark, path in [x for x in _staged[mark:] if x[1] not in stay]:
        _staged.remove((spark, path))
        _delete(spark, path)


def drop_staged(keep: int = 0) -> None:
    """Remove what ``stage`` wrote, but for the first ``keep`` tables."""
    while len(_staged) > keep:
        try:
            _delete(*_staged.pop())
        except Exception:  # the session is over; a cluster's own clean-up takes the folder
            return


def _delete(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def id_key(name: str = "doc_id") -> Column:
    """The id with null replaced by ``NULL_ID``."""
    return F.coalesce(F.col(name).cast("long"), F.lit(NULL_ID))


def id_bucket(name: str, mod: int) -> Column:
    """crc32 of the id as text, modulo ``mod``; a null id counts as empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col(name).cast("string"), F.lit("")).cast("binary")), F.lit(mod))


def utf8(name: str = "text") -> Column:
    """The text's UTF-8 bytes; null is empty."""
    return F.coalesce(F.col(name), F.lit("")).cast("binary")


def arrow_map(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[dict]], schema: str) -> DataFrame:
    """``mapInArrow`` for functions that yield dicts of columns."""
    types = _arrow_schema(df.sparkSession, schema)
    small_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for cols in fn(batches):
            arrays = [pa.array(cols[f.name], type=f.type) for f in types]
            if len(arrays[0]):
                yield pa.RecordBatch.from_arrays(arrays, schema=types)

    return df.mapInArrow(run, schema)


def _arrow_schema(spark: SparkSession, schema: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    return to_arrow_schema(StructType.fromDDL(schema))


def most_frequent(counts: DataFrame, key: str, n: str, limit: int) -> DataFrame:
    """About the ``limit`` rows of ``counts`` with the greatest ``n``, in steps of an eighth of a doubling.

    Of the step that doesn't fit whole, the rows whose hash of ``key`` lies under a share of all hashes that leaves four
    standard deviations of room. Only a histogram of bounded size goes to the driver to find the cut.
    """
    step = F.floor(F.log2(F.col(n)) * 8).cast("int")
    steps = sorted(((r.step, r["count"]) for r in counts.groupBy(step.alias("step")).count().collect()), reverse=True)
    room = limit
    for at, rows in steps:
        if rows > room:
            share = max(0.0, room - 4 * room**0.5) / rows
            drawn = F.pmod(F.xxhash64(key), F.lit(1 << 53)) < F.lit(int(share * (1 << 53)))
            return counts.where((step > at) | ((step == at) & drawn))
        room -= rows
    return counts
