"""Similarity of generated texts, leakage, sampling."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _ratios(truth: pd.Series, generated: pd.Series) -> pd.Series:
    from difflib import SequenceMatcher

    return pd.Series([SequenceMatcher(None, a or "", b or "").ratio() for a, b in zip(truth, generated)], dtype="float64")


def similarity(truth: Column, generated: Column) -> Column:
    """Ratcliff-Obershelp similarity with the default junk rule; not symmetric. Nulls are empty texts."""
    return F.pandas_udf(_ratios, "double")(truth, generated)


def register(spark) -> None:
    spark.udf.register("text_similarity", F.pandas_udf(_ratios, "double"))


def shuffle_key(id_: Column, seed: int, epoch: int) -> Column:
    """A key whose order is a fixed permutation for each seed and epoch."""
    return F.md5(F.concat_ws(":", F.lit(seed), F.lit(epoch), id_.cast("string")))


def share(id_: Column, salt: str) -> Column:
    """A number from 0 to 1 that depends on the id alone."""
    head = F.substring(F.md5(F.concat(F.lit(f"{salt}:"), id_.cast("string"))), 1, 8)
    return F.conv(head, 16, 10).cast("double") / F.lit(float(1 << 32))


def mixture(df: DataFrame, key: str, weights: dict[str, float], id_col: str) -> DataFrame:
    """Rows kept with their group's weight; groups without one go."""
    w = F.create_map(*(x for k, v in weights.items() for x in (F.lit(k), F.lit(v))))
    return df.where(share(F.col(id_col), "mix") < F.coalesce(F.get(F.array(w[F.col(key)]), F.lit(0)), F.lit(0.0)))


def upsampled(df: DataFrame, flag: str, times: int) -> DataFrame:
    return df.withColumn("copy", F.explode(F.sequence(F.lit(0), F.when(F.col(flag), times - 1).otherwise(0))))


def without_leaks(df: DataFrame, text: str, held_out: DataFrame, held_text: str) -> DataFrame:
    """Rows none of whose lines is, trimmed, a line of the held-out texts."""
    lines = lambda c: F.explode(F.transform(F.split(c, "\n"), lambda x: F.trim(x))).alias("line")
    own = held_out.select(lines(F.col(held_text))).where("line <> ''").distinct()
    d = df.withColumn("_row", F.xxhash64(text))
    leaked = d.select("_row", lines(F.col(text))).join(own, "line", "left_semi").select("_row").distinct()
    return d.join(leaked, "_row", "left_anti").drop("_row")


# -- verifiers of generated and target texts


def tables_closed(c: Column) -> Column:
    """Whether table, row and cell tags open and close equally often."""
    n = lambda p: F.regexp_count(c, F.lit(p))
    pairs = [n(f"(?i)<{t}(?:[ >])") == n(f"(?i)</{t}>") for t in ("table", "tr", "td", "th")]
    return pairs[0] & pairs[1] & pairs[2] & pairs[3]


def rows_even(c: Column) -> Column:
    """Whether all rows of a text's HTML tables have as many cells; spanning cells aren't counted up."""
    rows = F.regexp_extract_all(c, F.lit("(?is)<tr(?:[ >]).*?</tr>"), F.lit(0))
    return F.size(F.array_distinct(F.transform(rows, lambda r: F.regexp_count(r, F.lit("(?i)<t[dh](?:[ >])"))))) <= 1


def formulas_sound(c: Column) -> Column:
    """Whether dollar signs pair up and each formula's braces and environments balance."""
    signs = F.regexp_count(c, F.lit(r"(?<!\\)\$")) % 2 == 0
    inner = F.regexp_extract_all(c, F.lit(r"(?s)\$\$(.*?)\$\$|\$([^$\n]+)\$"), F.lit(0))
    even = lambda m: (F.regexp_count(m, F.lit(r"(?<!\\)\{")) == F.regexp_count(m, F.lit(r"(?<!\\)\}"))) & (F.regexp_count(m, F.lit(r"\\begin\{")) == F.regexp_count(m, F.lit(r"\\end\{")))
    return signs & F.forall(inner, even)


def _distances(a: pd.Series, b: pd.Series) -> pd.Series:
    def distance(x, y) -> int:
        if len(x) < len(y):
            x, y = y, x
        row = np.arange(len(y) + 1)
        known = {v: i for i, v in enumerate(dict.fromkeys(y))}
        code = np.array([known[v] for v in y], np.int64)
        steps = np.arange(len(y) + 1)
        for i, v in enumerate(x, 1):
            best = np.minimum(row[1:] + 1, row[:-1] + (code != known.get(v, -1)))
            row = np.concatenate([[i], best])
            row = np.minimum.accumulate(row - steps) + steps  # insertions
        return int(row[-1])

    return pd.Series([None if x is None or y is None else distance(x, y) for x, y in zip(a, b)], dtype="Int64")


def edit_distance(a: Column, b: Column) -> Column:
    """Insertions, deletions and replacements between two arrays of texts. Time is their sizes' product."""
    return F.pandas_udf(_distances, "long")(a, b)


def char_error_rate(truth: Column, generated: Column) -> Column:
    """Character edits for each character of the truth."""
    return F.levenshtein(truth, generated) / F.greatest(F.length(truth), F.lit(1))


def words(c: Column) -> Column:
    return F.array_remove(F.split(c, r"\s+"), "")


def word_error_rate(truth: Column, generated: Column) -> Column:
    return edit_distance(words(truth), words(generated)) / F.greatest(F.size(words(truth)), F.lit(1))


def blocks(c: Column) -> Column:
    """Paragraphs: what stands between blank lines."""
    return F.filter(F.transform(F.split(c, r"\n\s*\n"), lambda x: F.trim(x)), lambda x: x != "")


def block_order(truth: Column, generated: Column) -> Column:
    """Edits between the orders of paragraphs, for each paragraph of the longer text."""
    return edit_distance(blocks(truth), blocks(generated)) / F.greatest(F.size(blocks(truth)), F.size(blocks(generated)), F.lit(1))


def field_checks(df: DataFrame, target: str, licensed: str, by: list[str], leaked: str | None = None, sample: int = 20) -> DataFrame:
    """For each data set (by): rows, whether there are sample of them at least, and how many have an empty
    target, an open table, a faulty formula, no license, or text of a benchmark; over all rows."""
    t = F.coalesce(F.col(target), F.lit(""))
    count = lambda c, name: F.count_if(c).alias(name)
    return df.groupBy(*by).agg(
        F.count("*").alias("n"), (F.count("*") >= sample).alias("enough"), count(F.trim(t) == "", "empty"), F.min(F.length(t)).alias("shortest"), F.max(F.length(t)).alias("longest"), count(~tables_closed(t), "open_tables"),
        count(~formulas_sound(t), "faulty_formulas"), count(F.coalesce(F.col(licensed), F.lit("")) == "", "unlicensed"), count(F.col(leaked) if leaked else F.lit(False), "leaked"),
    )
