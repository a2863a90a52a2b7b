"""How rows reach Python: dealt evenly over tasks, and a few at a time within one."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

#: Rows that a task takes of a narrow table whose rows cost Python about a millisecond each.
TASK_ROWS = 10_000
#: Rows and bytes of a batch that are Python objects at one time (a row is never cut).
PIECE_ROWS, PIECE_BYTES = 256, 1 << 20


def spread(rows: DataFrame) -> DataFrame:
    """Rows dealt over as many tasks as their number asks for, one a core at least.

    A narrow Parquet table is one split, whatever is made of its rows later; all of that would be one task.
    """
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(max(cores, -(-rows.count() // TASK_ROWS)))


def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of Arrow batches in small batches: what Python makes of them follows a piece, not a batch."""
    for batch in batches:
        at = 0
        while at < batch.num_rows:
            part = batch.slice(at, PIECE_ROWS)
            while part.num_rows > 1 and part.nbytes > PIECE_BYTES:
                part = batch.slice(at, part.num_rows // 2)
            yield part
            at += part.num_rows
