"""Sources: JSON lines with their numbers, tolerant Parquet, archives, feeds, id lists, state logs, YAML."""

from __future__ import annotations

import gzip
import io
import os
import tarfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from quire.batches import small_batches
from quire.functions.text import strip
from quire.schema import SAMPLE
from quire.sources.yaml import parse_yaml


def numbered_lines(spark: SparkSession, path: str, by_time: bool = False) -> DataFrame:
    """(line, ln): physical lines with zero-based numbers, blank ones counted.

    Files follow each other by name, or first by when they were written (by_time), as a log's appended
    files do. A task may read several files' parts in any order, so lines are numbered within their part
    of a file and shifted by the counts of the parts before; there is a row for each part.
    """
    at = F.struct(*([F.col("_metadata.file_modification_time").alias("time")] if by_time else []), F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("start"))
    d = spark.read.text(path).select(F.col("value").alias("line"), at.alias("at"), F.monotonically_increasing_id().alias("m"))
    parts = d.groupBy("at").agg(F.count("*").alias("n"), F.min("m").alias("first"))
    parts = parts.select("at", (F.sum("n").over(W.orderBy("at")) - F.col("n") - F.col("first")).alias("shift"))
    return d.join(F.broadcast(parts), "at").select("line", (F.col("m") + F.col("shift")).alias("ln"))  # parts are as many as Spark's own list of them


def read_samples(spark: SparkSession, path: str, schema: T.StructType = SAMPLE) -> DataFrame:
    """Samples of a JSON lines file with ln and given, the keys that a line has, also those it sets to
    null; blank lines are skipped but counted."""
    lines = numbered_lines(spark, path).where(strip(F.col("line")) != "")
    return lines.select("ln", F.json_object_keys("line").alias("given"), F.from_json("line", schema).alias("s")).select("ln", "given", "s.*")


def read_columns(spark: SparkSession, path: str, want: dict[str, str]) -> DataFrame:
    """The wanted columns of Parquet files, null where they are missing."""
    d = spark.read.parquet(path)
    return d.select(*(F.col(f"`{c}`") if c in d.columns else F.lit(None).cast(t).alias(c) for c, t in want.items()))


class TarSource(DataSource):
    """spark.read.format("tar").load(dir or file): the files in tar archives of any compression.

    Columns: archive, member (without a leading ./), raw (as stored), ord, content. An archive is a
    partition and is read as a stream, from any file system that the path names. Option suffix keeps
    members with that ending.
    """

    @classmethod
    def name(cls) -> str:
        return "tar"

    def schema(self) -> str:
        return "archive string, member string, raw string, ord long, content binary"

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return _TarReader(self.options)


def located(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a URI or local path, and the path within it."""
    if "://" in path or path.startswith("file:"):
        return fs.FileSystem.from_uri(path)
    return fs.LocalFileSystem(), os.path.abspath(path)


class _TarReader(DataSourceReader):
    def __init__(self, options):
        self.path, self.suffix = options["path"], options.get("suffix", "")

    def partitions(self) -> list[InputPartition]:
        where, at = located(self.path)
        if where.get_file_info(at).type == fs.FileType.File:
            return [InputPartition(at)]
        found = where.get_file_info(fs.FileSelector(at, recursive=True))
        return [InputPartition(p) for p in sorted(f.path for f in found if f.type == fs.FileType.File and ".tar" in f.base_name)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        where, _ = located(self.path)
        with where.open_input_stream(partition.value, compression=None) as data, tarfile.open(fileobj=data, mode="r|*") as archive:
            for i, m in enumerate(archive):
                if m.isfile() and m.name.endswith(self.suffix):
                    yield os.path.basename(partition.value), m.name.removeprefix("./"), m.name, i, archive.extractfile(m).read()


def extract_sources(df: DataFrame, content: str = "content") -> DataFrame:
    """(path, name, text): the files of source bundles, each a tar archive or else one gzip file."""

    def files(data: bytes) -> Iterator[tuple[str, bytes]]:
        try:
            with tarfile.open(fileobj=io.BytesIO(data), mode="r:*") as t:
                for m in t:
                    if m.isfile():
                        yield m.name, t.extractfile(m).read()
        except tarfile.TarError:
            try:
                yield "main.tex", gzip.decompress(data)
            except (OSError, EOFError):
                return

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, data in zip(*batch.columns):  # a bundle at a time
                rows = [(path.as_py(), n, x.decode("utf-8", "replace")) for n, x in files(data.as_py() or b"")]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*rows)] if rows else [pa.array([], pa.string())] * 3, names=["path", "name", "text"])

    small_batches(df.sparkSession)
    return df.select("path", content).mapInArrow(run, "path string, name string, text string")


def tex_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, length) of the .tex files below path, empty ones too, which Spark's own file sources leave out.

    A level's folders are listed by tasks, level by level; the driver gets only the folders.
    """
    from quire.sources.writers import scratch

    _, root = located(path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where, _ = located(path)
        for batch in batches:
            for folder in batch.column(0).to_pylist():
                found = where.get_file_info(fs.FileSelector(folder, allow_not_found=True))
                for at in range(0, len(found), 10_000):
                    part = [f for f in found[at : at + 10_000] if f.type == fs.FileType.Directory or f.type == fs.FileType.File and f.base_name.endswith(".tex")]
                    yield pa.RecordBatch.from_arrays([pa.array([f.path for f in part], pa.string()), pa.array([None if f.type == fs.FileType.Directory else f.size for f in part], pa.int64())], names=["path", "length"])

    schema, out, folders = "path string, length long", scratch(spark, "listing"), [root]
    spark.createDataFrame([], schema).write.parquet(out)
    while folders:
        level = f"{out}-{uuid.uuid4().hex}"
        rows = spark.sparkContext.parallelize([(f,) for f in folders], min(len(folders), 1000)).toDF("path string")
        rows.mapInArrow(run, schema).write.parquet(level)
        d = spark.read.schema(schema).parquet(level)
        d.where("length IS NOT NULL").write.mode("append").parquet(out)
        folders = [r["path"] for r in d.where("length IS NULL").toLocalIterator()]
    return spark.read.schema(schema).parquet(out)


def read_feed(spark: SparkSession, path: str) -> DataFrame:
    """(id, title, authors, cats) of an Atom feed's entries."""
    schema = "id string, title string, author array<struct<name string>>, category array<struct<_term string>>"
    d = spark.read.format("xml").option("rowTag", "entry").schema(schema).load(path)
    title = F.trim(F.regexp_replace("title", r"\s+", " "))
    return d.select(
        F.regexp_replace(F.substring_index("id", "/abs/", -1), r"v\d+$", "").alias("id"), title.alias("title"),
        F.array_join(F.filter(F.transform("author", lambda a: a["name"]), lambda n: n != ""), ", ").alias("authors"), F.transform("category", lambda c: c["_term"]).alias("cats"),
    )


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """Ids of a mixed file: a line that opens a JSON object has an arxiv_id, any other is an id."""
    line = F.trim("value")
    d = spark.read.text(path).select(F.when(line.startswith("{"), F.get_json_object(line, "$.arxiv_id")).otherwise(line).alias("id"))
    return d.where("id <> ''")


def read_state(spark: SparkSession, path: str) -> DataFrame:
    """(path, digest) of a verification log: broken lines are skipped, the last line of a path wins. Of
    several files, those written later come later."""
    log = numbered_lines(spark, path, by_time=True).select("ln", F.from_json("line", "path string, size long, sha256 string, digest string").alias("s")).where("s.path IS NOT NULL")
    d = log.groupBy("s.path").agg(F.max_by(F.struct(F.coalesce("s.sha256", "s.digest").alias("digest")), "ln").alias("last"))
    return d.select("path", "last.digest").where("digest IS NOT NULL")


def read_config(path: str, defaults: dict | None = None) -> dict:
    """A run configuration over its defaults. What the YAML reader doesn't know raises ValueError."""
    where, at = located(path)
    with where.open_input_stream(at) as f:
        found = parse_yaml(f.read().decode())
    if not isinstance(found, dict | None):
        raise ValueError(f"{path} is no mapping")
    return {**(defaults or {}), **(found or {})}
