"""What the operators of this subpackage share: Arrow row maps, the cluster's shared folder, folds."""

from __future__ import annotations

import gc
import os
import tempfile
import uuid
import zlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

#: A kernel gets at most so many rows, or about so many bytes of Arrow data, at once.
SLICE_ROWS, SLICE_BYTES = 1024, 8 << 20
BATCH_ROWS = 1000


def small_batches(spark: SparkSession) -> None:
    """Arrow batches of BATCH_ROWS rows at most: texts may be long, and several batches are held at once."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir. Only on a single machine, as in tests, one is
    set here where that is unset."""
    small_batches(spark)
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        where = f"file://{tempfile.mkdtemp(prefix='quire-')}"
        spark.conf.set("spark.checkpoint.dir", where)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(where)
    return where.rstrip("/")


def fresh_dir(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str, *over: DataFrame) -> DataFrame:
    """df as a table in the shared folder, read back: its lineage ends there. Tables written before that
    nothing else needs any more are given as over, and deleted."""
    spark = df.sparkSession
    path = fresh_dir(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._quire_path = path
    for old in over:
        fs, at = filesystem(old._quire_path)
        fs.delete_dir(at)
    return out


def settle(spark: SparkSession) -> None:
    """Shuffle files of finished stages go when the driver collects its garbage. That is done here, so
    that they don't pile up until its memory is full."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def filesystem(uri: str) -> tuple[fs.FileSystem, str]:
    if "://" in uri or uri.startswith("file:"):
        return fs.FileSystem.from_uri(uri)
    return fs.LocalFileSystem(), os.path.abspath(uri)


def slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches cut so that a kernel's working set stays bounded however long the texts are."""
    for batch in batches:
        rows = batch.num_rows
        if rows:
            step = max(1, min(SLICE_ROWS, rows * SLICE_BYTES // max(batch.nbytes, 1)))
            for at in range(0, rows, step):
                yield batch.slice(at, step)


def map_rows(df: DataFrame, kernel: Callable[..., tuple], schema: str, setup: Callable[[], object] | None = None) -> DataFrame:
    """Each slice's columns as Python lists through kernel, which returns the output columns.

    setup, if given, is called once a task; what it returns is the kernel's first argument.
    """
    small_batches(df.sparkSession)
    out = T._parse_datatype_string(schema)
    arrow = to_arrow_schema(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = (setup(),) if setup else ()
        for part in slices(batches):
            columns = kernel(*first, *(c.to_pylist() for c in part.columns))
            yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(columns, arrow, strict=True)], schema=arrow)

    return df.mapInArrow(run, out)


def fold(doc_id: int | None, parts: int) -> int:
    """crc32 of the id as text, modulo parts; a null id counts as empty text."""
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % parts


def fold_column(id_col: str, parts: int):
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % parts
