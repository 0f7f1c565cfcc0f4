"""Repository manifests, their files on disk, and the log of what was verified."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.operators.pages import last_wins

SIBLINGS = "array<struct<rfilename:string,size:bigint,blobId:string,lfs:struct<size:bigint,sha256:string>>>"


def entries(raw: DataFrame, column: str = "json", tar_only: bool = False) -> DataFrame:
    """(path, size, hash_kind, digest, error) of the files in manifests; large files have SHA-256, others
    a git blob's SHA-1. error is null for valid entries."""
    d = raw.select(F.explode(F.from_json(column, f"siblings {SIBLINGS}")["siblings"]).alias("s")).select("s.*")
    big = F.col("lfs").isNotNull()
    d = d.select(
        F.col("rfilename").alias("path"),
        F.when(big, F.col("lfs.size")).otherwise(F.col("size")).alias("size"),
        F.when(big, "sha256").otherwise("git-sha1").alias("hash_kind"),
        F.when(big, F.col("lfs.sha256")).otherwise(F.col("blobId")).alias("digest"),
    )
    if tar_only:
        d = d.where(F.col("path").endswith(".tar"))
    least = 1 if tar_only else 0
    length = F.when(F.col("hash_kind") == "sha256", 64).otherwise(40)
    error = F.when(unsafe(F.col("path")), "path").when(F.coalesce("size", F.lit(-1)) < least, "size").when(F.length(F.coalesce("digest", F.lit(""))) != length, "digest")
    return d.withColumn("error", error)


def unsafe(path: Column) -> Column:
    return path.startswith("/") | F.array_contains(F.split(path, "/"), "..")


def bucket(path: Column) -> Column:
    return F.when(F.instr(path, "/") == 0, "(root)").otherwise(F.substring_index(path, "/", 1))


def identity(kind: Column, digest: Column) -> Column:
    return F.concat(kind, F.lit(":"), digest)


def totals(df: DataFrame) -> DataFrame:
    """Files and bytes of each bucket, and of all as TOTAL."""
    d = df.rollup("bucket").agg(F.count("*").alias("files"), F.sum("size").alias("bytes"), F.grouping("bucket").alias("all"))
    return d.select(F.when(F.col("all") == 1, "TOTAL").otherwise(F.col("bucket")).alias("bucket"), "files", "bytes")


def remaining(manifest: DataFrame, on_disk: DataFrame) -> DataFrame:
    """Bytes still to fetch: what a finished or partial file of at most the right size holds is reused."""
    d = manifest.join(on_disk, "path", "left")
    fits = lambda c: F.when(F.col(c) <= F.col("size"), F.col(c)).otherwise(0)
    left = F.col("size") - F.greatest(F.coalesce(fits("final"), F.lit(0)), F.coalesce(fits("part"), F.lit(0)))
    return d.agg(F.sum(left).alias("bytes_left"))


def fits(left: DataFrame, free: int, reserve: int = 0) -> DataFrame:
    """bytes_left with whether it and a reserve are free."""
    return left.withColumn("fits", F.coalesce("bytes_left", F.lit(0)) + reserve <= free)


def last_state(log: DataFrame, order: str) -> DataFrame:
    """The last digest that the log has for each path."""
    return last_wins(log, ["path"], order)


def unverified(manifest: DataFrame, state: DataFrame) -> DataFrame:
    return manifest.join(state.select("path", "digest"), ["path", "digest"], "left_anti")


def appended(state: DataFrame, new: DataFrame) -> DataFrame:
    """The rows of new that a state log doesn't hold already with the same digest."""
    return unverified(new, state)


def blob_sha1(content: Column) -> Column:
    head = F.concat(F.lit("blob "), F.length(content).cast("string")).cast("binary")
    return F.sha1(F.concat(head, F.lit(bytearray(b"\0")), content))


def kind_of(content: Column) -> Column:
    """pdf, gzip or tar by the first bytes, else null."""
    is_ = lambda at, sign: F.substring(content, at, len(sign)) == F.lit(bytearray(sign))
    return F.when(is_(1, b"%PDF"), "pdf").when(is_(1, b"\x1f\x8b"), "gzip").when(is_(258, b"ustar"), "tar")
