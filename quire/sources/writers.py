"""Sinks: JSON lines, id lists, states, texts, archives; and a scratch folder."""

from __future__ import annotations

import io
import json
import tarfile
import tempfile
import time
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.sources.readers import read_state


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder below the one that the cluster shares. Only a single machine may do without."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        where = f"file://{tempfile.mkdtemp(prefix='quire-')}"
        spark.conf.set("spark.checkpoint.dir", where)
    return f"{where.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def write_jsonl(df: DataFrame, path: str, append: bool = False) -> None:
    """UTF-8, an object a line, nulls kept; replaces what was there unless append."""
    df.write.mode("append" if append else "overwrite").option("ignoreNullFields", "false").json(path)


def write_selection(df: DataFrame, path: str, id_col: str) -> None:
    """The selected rows and, beside them, their ids, one a line."""
    write_jsonl(df, f"{path}/selected")
    df.sparkSession.read.json(f"{path}/selected").select(F.col(id_col).cast("string")).write.mode("overwrite").text(f"{path}/ids")


def write_good(df: DataFrame, ok: str, path: str) -> None:
    write_jsonl(df.where(ok), path)


@contextmanager
def locked(spark: SparkSession, path: str, wait: float = 60.0) -> Iterator[None]:
    """Holds path.lock, which its file system creates for one writer only. A lock that stays after its
    writer was killed must be deleted by hand; after wait seconds the next writer raises TimeoutError."""
    jvm, lock = spark.sparkContext._jvm, f"{path.rstrip('/')}.lock"
    file = jvm.org.apache.hadoop.fs.Path(lock)
    where = file.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    end = time.time() + wait
    while not where.createNewFile(file):
        if time.time() > end:
            raise TimeoutError(f"{lock} is held by another writer")
        time.sleep(0.2)
    try:
        yield
    finally:
        where.delete(file, False)


def append_state(new: DataFrame, path: str) -> None:
    """Appends the rows of new whose path doesn't already have the same digest as its last entry; each
    with the time. One writer at a time reads the log and appends to it; a job's files appear together."""
    spark = new.sparkSession
    with locked(spark, path):
        state = read_state(spark, path) if _exists(spark, path) else spark.createDataFrame([], "path string, digest string")
        rows = new.dropDuplicates(["path", "digest"]).join(state.select("path", "digest"), ["path", "digest"], "left_anti")
        write_jsonl(rows.withColumn("verified_at", F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss'Z'")), path, append=True)


def _exists(spark: SparkSession, path: str) -> bool:
    file = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return file.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(file)


def write_audit(data: dict, path: str) -> None:
    """A small summary, sorted and indented."""
    where, at = fs.FileSystem.from_uri(path)
    with where.open_output_stream(at) as f:
        f.write((json.dumps(data, indent=2, sort_keys=True, ensure_ascii=False) + "\n").encode())


def write_texts(df: DataFrame, column: str, path: str, append: bool = False) -> None:
    df.select(column).write.mode("append" if append else "overwrite").text(path)


def write_tars(df: DataFrame, path: str, member: str, content: str) -> None:
    """A tar archive for each partition of df."""
    where, root = fs.FileSystem.from_uri(path)
    where.create_dir(root, recursive=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where, root = fs.FileSystem.from_uri(path)
        name, n = f"{root}/{uuid.uuid4().hex}.tar.gz", 0
        with where.open_output_stream(name, compression=None) as out, tarfile.open(fileobj=out, mode="w|gz") as archive:
            for batch in batches:
                for m, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                    info = tarfile.TarInfo(m)
                    info.size = len(data)
                    archive.addfile(info, io.BytesIO(data))
                    n += 1
        yield pa.RecordBatch.from_pydict({"name": [name], "n": pa.array([n], pa.int64())})

    df.select(member, F.col(content).cast("binary")).mapInArrow(run, "name string, n long").write.mode("overwrite").parquet(f"{path}-list")
