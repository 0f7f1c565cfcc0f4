"""Arrow batches of bounded size for what runs in Python."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import SparkSession

BATCH_ROWS, SLICE_BYTES = 1000, 8 << 20


def small_batches(spark: SparkSession) -> None:
    """BATCH_ROWS rows at most: texts may be long, and several batches are held at once."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))


def slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches cut to about SLICE_BYTES, a row at least."""
    for batch in batches:
        step = max(1, batch.num_rows * SLICE_BYTES // max(batch.nbytes, SLICE_BYTES))
        for at in range(0, batch.num_rows, step):
            yield batch.slice(at, step)
