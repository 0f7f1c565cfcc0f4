"""Filters, projections and deduplication of page rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quire.functions.text import locator, strip
from quire.sources.writers import scratch


def not_false(c: Column) -> Column:
    return ~c.eqNullSafe(F.lit(False))


def not_true(c: Column) -> Column:
    return ~c.eqNullSafe(F.lit(True))


def convertible(df: DataFrame, language: str | None = "en", min_chars: int = 200, max_chars: int = 5000, skip_tables: bool = False, chunks: list[str] | None = None) -> DataFrame:
    """Pages that are converted: cheap tests first, patterns last. Flags drop only what is known to be
    wrong; a null flag keeps its row. 0 and empty settings are off."""
    if language:
        df = df.where(F.col("primary_language") == language)
    df = df.where(not_false(F.col("is_rotation_valid")) & not_true(F.col("is_diagram")))
    if skip_tables:
        df = df.where(not_true(F.col("is_table")))
    if chunks:
        df = df.where(F.col("chunk").isin(chunks))
    n = F.length(strip(F.col("natural_text")))
    df = df.where(F.col("natural_text").isNotNull() & (n > 0))
    if min_chars:
        df = df.where(n >= min_chars)
    if max_chars:
        df = df.where(n <= max_chars)
    return df


def located(df: DataFrame, path: str = "pdf_relpath") -> DataFrame:
    """With chunk_of and member of the locator; rows without one are dropped."""
    chunk, member = locator(F.col(path))
    return df.withColumns({"chunk_of": chunk, "member": member}).where("chunk_of <> ''")


def last_wins(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Of the rows of a key, that with the greatest order: a maximum with map-side combination."""
    rest = [c for c in df.columns if c not in keys]
    d = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("last"))
    return d.select(*keys, *(F.col("last").getField(c).alias(c) for c in rest))


def positions(df: DataFrame, within: list[str], name: str) -> DataFrame:
    """Dense zero-based positions by within. The rows are range-partitioned, sorted and written once; a
    row's place within its part is then known, and is shifted by the counts of the parts before."""
    spark = df.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    path = scratch(spark, "sorted")
    df.repartitionByRange(n, *within).sortWithinPartitions(*within).withColumn("_m", F.monotonically_increasing_id()).write.parquet(path)
    d = spark.read.parquet(path).withColumn("_part", F.shiftright("_m", 33))
    counts = d.groupBy("_part").count()  # as many rows as shuffle partitions
    before = counts.select("_part", (F.sum("count").over(W.orderBy("_part")) - F.col("count")).alias("_before"))
    d = d.join(F.broadcast(before), "_part")
    return d.withColumn(name, F.col("_before") + F.col("_m").bitwiseAND(F.lit((1 << 33) - 1))).drop("_part", "_before", "_m")


def sequence_ids(df: DataFrame, order: str, prefix: str, digits: int, name: str = "sample_id") -> DataFrame:
    """Dense zero-based ids in order, after all filters."""
    d = positions(df, [order], "_at")
    return d.withColumn(name, F.concat(F.lit(prefix), F.lpad(F.col("_at").cast("string"), digits, "0"))).drop("_at")


def fixed_groups(df: DataFrame, order: str, size: int, text: str, separator: str, of: list[str] | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """Groups of size rows in a row, incomplete ones dropped: (of, group, n, first, members, rows, joined).

    Rows are numbered over all of the table, and each value of the of columns begins anew at the least
    of its numbers, so no task holds all rows of a value.
    """
    of = of or []
    d = positions(df.select(*of, order, text, *(c for c in keep if c not in (*of, order, text))), [*of, order], "_at")
    if of:
        begins = d.groupBy(*of).agg(F.min("_at").alias("_begin"))
        d = d.alias("d").join(begins.alias("b"), F.expr(" AND ".join(f"d.`{c}` <=> b.`{c}`" for c in of))).select("d.*", (F.col("_at") - F.col("_begin")).alias("_place"))
    else:
        d = d.withColumn("_place", F.col("_at"))
    row = F.struct(F.col(order).alias("o"), F.col(text).alias("t"), F.struct(*keep).alias("r")) if keep else F.struct(F.col(order).alias("o"), F.col(text).alias("t"))
    g = d.groupBy(*of, F.floor(F.col("_place") / size).alias("group")).agg(F.sort_array(F.collect_list(F.struct(F.col("_place").alias("p"), row.alias("x")))).alias("m")).where(F.size("m") == size)
    return g.select(
        *of, "group", F.size("m").alias("n"), F.get("m", F.lit(0))["x"]["o"].alias("first"), F.transform("m", lambda x: x["x"]["o"]).alias("members"),
        *([F.transform("m", lambda x: x["x"]["r"]).alias("rows")] if keep else []), F.array_join(F.transform("m", lambda x: x["x"]["t"]), separator).alias("joined"),
    )
