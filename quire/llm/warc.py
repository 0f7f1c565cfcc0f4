"""WARC archives: written by tasks, read back in byte ranges by boundary-chain verification.

A range of a file may begin anywhere, and a payload may hold what looks like a record's first bytes. So
the tasks emit every candidate, an offset with the magic where a record can be read, with its successor,
the offset at which that record ends. Within a range, chains are followed at once to the first offset
beyond it; over ranges, pointer jumping from the file's start doubles the distance each round. Only the
records reached are kept, and each is read by the task whose range it begins in.

Archives are plain (magic `WARC/1.`) or gzip with a member a record (magic 1f 8b 08).

Defined cases: a null payload is an empty one; a null page id gives a record of its own without an id,
and comes after all ids: a payload that some id has is revisited, else the record is a response. Rows
that repeat the smallest page id of a payload are all responses; other copies revisit it. Payloads
under MIN_REVISIT bytes are never revisits. An empty table gives an empty one. Other columns are not
read, so names can't clash.
"""

from __future__ import annotations

import base64
import hashlib
import os
import uuid
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from quire.llm.common import filesystem, fresh_dir, slices, table, written

MIN_REVISIT, FILE_BYTES, RANGE_BYTES = 100, 64 << 20, 8 << 20
#: Ranges that a task reads one after another, once there are enough for all cores.
RANGES_PER_TASK = 16
PLAIN, GZIP = b"WARC/1.", b"\x1f\x8b\x08"
HEADER_STEP = 64 << 10


class Record(NamedTuple):
    headers: dict[str, str]
    payload: bytes
    end: int


def record_bytes(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    name = lambda i: f"<urn:page:{'' if i is None else i}>"
    revisit = refers_to is not None
    body = b"" if revisit else payload
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: {name(page_id)}",
        "WARC-Date: 2026-01-01T00:00:00Z",
        f"WARC-Target-URI: {(url or '').encode('unicode_escape').decode()}",
        f"WARC-Payload-Digest: sha256:{base64.b32encode(bytes.fromhex(digest)).decode().rstrip('=')}",
        f"Payload-Length: {len(payload)}",
        "Content-Type: text/html",
        f"Content-Length: {len(body)}",
    ]
    if revisit:
        lines[4:4] = [f"WARC-Refers-To: {name(refers_to)}", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


def roles(pages: DataFrame, id_col: str = "page_id", payload_col: str = "html") -> DataFrame:
    """digest, least: the response's id for every payload of MIN_REVISIT bytes or more that several ids share."""
    body = F.coalesce(F.col(payload_col), F.lit("")).cast("binary")
    d = pages.select(F.col(id_col).cast("long").alias("id"), F.length(body).alias("n"), F.sha2(body, 256).alias("digest")).where(F.col("n") >= MIN_REVISIT)
    return d.groupBy("digest").agg(F.min("id").alias("least"), F.max("id").alias("most"), F.count("*").alias("rows"), F.count("id").alias("ids"))


def write_archive(pages: DataFrame, out: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", gzip: bool = True, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Writes all pages below out and returns the files: (path, bytes, records).

    Only digests that rows share travel; the payloads are shuffled once, to join them. A digest's rows
    aren't gathered: adaptive execution splits its partition, and tasks write what they get.
    """
    shared = written(roles(pages, id_col, payload_col).where("rows > 1 AND least IS NOT NULL").select("digest", "least"), "roles")
    body = F.coalesce(F.col(payload_col), F.lit("")).cast("binary")
    d = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).alias("url"), body.alias("body"), F.sha2(body, 256).alias("digest"))
    n = shared.count()
    # a digest and an id take under 200 bytes: the copied side is broadcast only where all of it is small
    d = d.join(F.broadcast(shared) if n <= 20_000 else shared, "digest", "left")
    d = d.select("id", "url", "body", "digest", F.when((F.length("body") >= MIN_REVISIT) & (F.col("id").isNull() | (F.col("id") > F.col("least"))), F.col("least")).alias("refers"))
    schema = T._parse_datatype_string("path string, bytes long, records long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = filesystem(out)
        done, stream, size, n, name = [], None, 0, 0, ""
        for part in slices(batches):
            for page_id, url, payload, digest, refers in zip(*(c.to_pylist() for c in part.columns)):
                if stream is None:
                    name = f"{root}/{TaskContext.get().partitionId():05d}-{uuid.uuid4().hex}.warc{'.gz' * gzip}"
                    stream, size, n = fs.open_output_stream(name, compression=None), 0, 0
                data = record_bytes(page_id, url, payload, digest, refers)
                if gzip:
                    packer = zlib.compressobj(1, wbits=31)
                    data = packer.compress(data) + packer.flush()
                stream.write(data)
                size, n = size + len(data), n + 1
                if size >= file_bytes:
                    stream.close()
                    done.append((name, size, n))
                    stream = None
        if stream is not None:
            stream.close()
            done.append((name, size, n))
        yield pa.RecordBatch.from_pylist([dict(zip(("path", "bytes", "records"), x)) for x in done], schema=to_arrow_schema(schema))

    fs, root = filesystem(out)
    fs.create_dir(root, recursive=True)
    # what a lost or repeated task left behind isn't in this table, so it is never read
    return written(d.mapInArrow(run, schema), "warc-files")


def _blank_line(data: memoryview | bytes, at: int) -> int:
    """The offset of the first blank line from at on, however far, or -1."""
    while at < len(data):
        found = bytes(data[at : at + HEADER_STEP]).find(b"\r\n\r\n")
        if found >= 0:
            return at + found
        at += HEADER_STEP - 3  # a blank line may begin in one step and end in the next
    return -1


def read_record(data: memoryview | bytes, at: int, whole: bool) -> Record | int | None:
    """The record at offset at; None if there is none; -1 if more bytes are needed (not whole)."""
    if data[at : at + 3] == GZIP:
        unpack, parts, end = zlib.decompressobj(wbits=31), [], at
        try:
            while end < len(data) and not unpack.eof:
                parts.append(unpack.decompress(data[end : end + (1 << 15)]))
                end += min(1 << 15, len(data) - end)
        except zlib.error:
            return None
        if not unpack.eof:
            return None if whole else -1
        plain = b"".join(parts)
        found = read_record(plain, 0, True) if plain[: len(PLAIN)] == PLAIN else None
        if not isinstance(found, Record) or found.end != len(plain):
            return None
        return found._replace(end=end - len(unpack.unused_data))
    if data[at : at + len(PLAIN)] != PLAIN:
        return None
    cut = _blank_line(data, at)
    if cut < 0:
        return None if whole else -1
    headers = {}
    for line in bytes(data[at:cut]).decode("utf-8", "replace").split("\r\n")[1:]:
        key, colon, value = line.partition(":")
        if not colon:
            return None
        headers[key.strip().lower()] = value.strip()
    size = headers.get("content-length", "")
    if not (size.isascii() and size.isdigit()):
        return None
    start = cut + 4
    end = start + int(size) + 4
    if end > len(data):
        return None if whole else -1
    if bytes(data[end - 4 : end]) != b"\r\n\r\n":
        return None
    return Record(headers, bytes(data[start : end - 4]), end)


class Range:
    """A file's bytes from start, read on as far as the records that begin before end need."""

    def __init__(self, path: str, start: int, end: int, size: int):
        fs, at = filesystem(path)
        self.file, self.start, self.end, self.size = fs.open_input_file(at), start, end, size
        self.data = self.file.read_at(min(end + 16 - start, size - start), start)

    def record(self, offset: int) -> Record | None:
        more = 1 << 16
        while True:
            found = read_record(memoryview(self.data), offset - self.start, self.start + len(self.data) >= self.size)
            if found != -1:
                return found._replace(end=found.end + self.start) if isinstance(found, Record) else None
            have = self.start + len(self.data)
            self.data += self.file.read_at(min(more, self.size - have), have)
            more *= 2

    def candidates(self) -> Iterator[int]:
        magic = GZIP if self.gzip() else PLAIN
        at = self.data.find(magic)
        while 0 <= at < self.end - self.start:
            yield self.start + at
            at = self.data.find(magic, at + 1)

    def gzip(self) -> bool:
        return self.file.read_at(min(3, self.size), 0) == GZIP


def byte_ranges(files: DataFrame, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """files (path, bytes) in ranges: (path, bytes, start, end)."""
    at = F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.col("bytes") - 1, F.lit(0)), F.lit(range_bytes).cast("long")))
    d = files.where("bytes > 0").select("path", "bytes", at.alias("start"))
    return d.withColumn("end", F.least(F.col("start") + range_bytes, "bytes"))


def candidates(ranges: DataFrame) -> DataFrame:
    """Per candidate: path, start (of its range), offset, succ (its record's end), out (the first offset
    of its chain beyond the range), n (the chain's records before out)."""
    schema = "path string, start long, offset long, succ long, `out` long, n long"
    arrow = to_arrow_schema(T._parse_datatype_string(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, size, start, end in zip(*(c.to_pylist() for c in batch.columns)):
                span = Range(path, start, end, size)
                succ = {at: found.end for at in span.candidates() if (found := span.record(at))}
                out, n = {}, {}
                for at in sorted(succ, reverse=True):
                    out[at], n[at] = out.get(succ[at], succ[at]), n.get(succ[at], 0) + 1
                rows = [(path, start, at, succ[at], out[at], n[at]) for at in sorted(succ)]
                yield _batch(rows, arrow)

    return ranges.select("path", "bytes", "start", "end").mapInArrow(run, schema)


def verified(found: DataFrame, files: DataFrame) -> DataFrame:
    """The offsets at which each range is entered by its file's chain: (path, offset).

    Chains over ranges are the rows (offset, out); pointer jumping from offset 0 reaches a file's last
    range in as many rounds as the logarithm of its ranges, and the driver gets a count a round.
    """
    jumps = found.select("path", "offset", "out")
    reached = files.where("bytes > 0").select("path", F.lit(0).cast("long").alias("offset"))
    count, old, made = -1, [], []
    while True:
        step = reached.join(jumps, ["path", "offset"]).select("path", F.col("out").alias("offset"))
        now = written(reached.unionByName(step).distinct(), "reached", *old)
        n = now.count()
        if n == count:
            return now
        reached, count, old = now, n, [now]
        double = jumps.alias("x").join(jumps.alias("y"), F.expr("x.path = y.path AND x.out = y.offset"), "left")
        jumps = written(double.select("x.path", "x.offset", F.coalesce("y.out", "x.out").alias("out")), "jumps", *made)
        made = [jumps]


def _whole(files: DataFrame, reached: DataFrame, entries: DataFrame) -> None:
    """Raises unless each file's chain ends at its size, and has the records that files counts, if it does."""
    ends = reached.select("path", F.col("offset").alias("bytes")).withColumn("ended", F.lit(True))
    counts = entries.groupBy("path").agg(F.sum("n").alias("found"))
    known = F.col("records") if "records" in files.columns else F.col("found")
    d = files.where("bytes > 0").join(ends, ["path", "bytes"], "left").join(counts, "path", "left")
    bad = d.where(F.col("ended").isNull() | ~known.eqNullSafe(F.col("found"))).select("path", "bytes", "found").take(3)
    if bad:
        raise ValueError(f"archives that can't be read to their end or count (path, bytes, records found): {[tuple(r) for r in bad]}")


def read_archive(files: DataFrame, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """Per record: page_id, record_type, refers_to, payload_bytes, payload_digest, payload (null for revisits)."""
    ranges = written(byte_ranges(files, range_bytes), "ranges")
    # rows are small, but not what they stand for: they are dealt evenly, several to a task once all cores have some
    n, cores = ranges.count(), 4 * files.sparkSession.sparkContext.defaultParallelism
    tasks = max(1, min(n, cores), -(-n // RANGES_PER_TASK))
    found = written(candidates(ranges.repartition(tasks)), "candidates")
    # a chain enters a range at one offset at most: that one and its successors within the range are records
    reached = verified(found, files)
    entries = reached.join(found.select("path", "start", "offset", "n"), ["path", "offset"])
    _whole(files, reached, entries)
    todo = ranges.join(entries, ["path", "start"]).select("path", "bytes", "start", "end", "offset").repartition(tasks)
    schema = "page_id long, record_type string, refers_to long, payload_bytes long, payload_digest string, payload binary"
    arrow = to_arrow_schema(T._parse_datatype_string(schema))

    def number(urn: str | None) -> int | None:
        text = (urn or "").removeprefix("<urn:page:").removesuffix(">")
        return int(text) if text else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, size, start, end, offset in zip(*(c.to_pylist() for c in batch.columns)):
                span, rows, held = Range(path, start, end, size), [], 0
                while offset < end:
                    r = span.record(offset)
                    if r is None:
                        raise ValueError(f"{path}: no record at {offset}")
                    kind = r.headers.get("warc-type", "")
                    if kind == "revisit":
                        code = r.headers["warc-payload-digest"].removeprefix("sha256:")
                        digest = base64.b32decode(code + "=" * (-len(code) % 8)).hex()
                        rows.append((number(r.headers.get("warc-record-id")), kind, number(r.headers["warc-refers-to"]), int(r.headers["payload-length"]), digest, None))
                    else:
                        rows.append((number(r.headers.get("warc-record-id")), kind, None, len(r.payload), hashlib.sha256(r.payload).hexdigest(), r.payload))
                    offset, held = r.end, held + len(r.payload)
                    if held > 4 << 20:
                        yield _batch(rows, arrow)
                        rows, held = [], 0
                yield _batch(rows, arrow)

    return todo.mapInArrow(run, schema)


def _batch(rows: list, arrow: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(list(zip(*rows)) or [()] * len(arrow), arrow)], schema=arrow)


def query(spark, sf_dir: str) -> DataFrame:
    files = write_archive(table(spark, sf_dir, "pages"), fresh_dir(spark, "warc"))
    return read_archive(files).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def local_files(spark, paths: list[str]) -> DataFrame:
    """A table of given local archives for read_archive."""
    return spark.createDataFrame([(p, os.path.getsize(p)) for p in paths], "path string, bytes long")


ORACLE = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
d AS (SELECT page_id, strlen(h) AS n, sha256(h) AS g FROM p),
m AS (SELECT g, min(page_id) AS least FROM d WHERE n >= {MIN_REVISIT} GROUP BY g)
SELECT page_id, n::BIGINT AS payload_bytes, g AS payload_digest,
       CASE WHEN least IS NOT NULL AND (page_id IS NULL OR page_id > least) THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN page_id IS NULL OR page_id > least THEN least END AS refers_to
FROM d LEFT JOIN m USING (g)
"""
