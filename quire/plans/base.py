"""Registration of queries, and the tables that several of them start from."""

from __future__ import annotations

from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a function under its own name, with the SQL that checks it."""

    def add(f):
        @wraps(f)
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            d = f(spark, sf_dir)  # whole numbers are longs in every result
            return d.select(*(F.col(f"`{c}`").cast("long").alias(c) if t == "int" else F.col(f"`{c}`") for c, t in d.dtypes))

        QUERIES[f.__name__] = run
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Page rows: documents with their labels as flags, null where there is no label."""
    d, l = read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels")
    d = d.join(l, "doc_id", "left")
    member = F.concat(F.when(F.col("doc_id") % 2 == 0, "./").otherwise(""), F.col("doc_id").cast("string"), F.lit(".pdf"))
    return d.select(
        F.col("doc_id").alias("ord"),
        F.concat(F.lit("doc_"), F.col("doc_id")).alias("id"),
        F.col("text").alias("natural_text"),
        F.col("lang").alias("primary_language"),
        (F.col("quality") != 0).alias("is_rotation_valid"),
        (F.col("toxic") == 1).alias("is_diagram"),
        F.col("text").contains("|").alias("is_table"),
        F.col("source").alias("chunk"),
        F.concat(F.lit("pdf_tarballs/"), "source", F.lit(".tar.gz:"), member).alias("pdf_relpath"),
        (F.col("doc_id") % 5).alias("page_number"),
        (F.length("text") % 900 + 100).alias("img_w"),
        (F.length("lang") + F.col("doc_id") % 7).alias("img_h"),
    )


PAGES = """pages0 AS (
  SELECT d.doc_id AS ord, 'doc_' || d.doc_id AS id, text AS natural_text, lang AS primary_language, quality <> 0 AS is_rotation_valid,
         toxic = 1 AS is_diagram, contains(text, '|') AS is_table, source AS chunk, d.doc_id % 5 AS page_number, length(text) % 900 + 100 AS img_w, length(lang) + d.doc_id % 7 AS img_h,
         'pdf_tarballs/' || source || '.tar.gz:' || CASE WHEN d.doc_id % 2 = 0 THEN './' ELSE '' END || d.doc_id || '.pdf' AS pdf_relpath
  FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)"""
WITH_PAGES = f"WITH {PAGES}"

#: events as files of a repository: path, size, digest, and a log of their states by time.
FILES = """files0 AS (
  SELECT event_id, event_type || '/' || (event_id % 50) || '.tar' AS path, event_type AS bucket, CAST(floor(abs(value) * 1000) AS BIGINT) AS size,
         sha256(CAST(event_id AS VARCHAR)) AS digest, user_id FROM events)"""
WITH_FILES = f"WITH {FILES}"


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events")
    return e.select(
        "event_id",
        F.concat("event_type", F.lit("/"), F.col("event_id") % 50, F.lit(".tar")).alias("path"),
        F.col("event_type").alias("bucket"),
        F.floor(F.abs("value") * 1000).cast("long").alias("size"),
        F.sha2(F.col("event_id").cast("string"), 256).alias("digest"),
        "user_id",
    )
