"""Document fingerprints by a homomorphic multiset hash.

Every paragraph (a line that isn't blank) is hashed to a wide vector, and a text's fingerprint is the
sum of its paragraphs' vectors modulo powers of two: the paragraphs' order doesn't matter, and a
paragraph is inserted or deleted by adding or subtracting its vector. The vector has WIDE lanes modulo
2^64 of the whole paragraph, for equality, and LANES lanes modulo 2^32 that sum signs of its groups of
GROUP words, for likeness: the squared distance of two such sums estimates how many groups differ. A text
has fewer than 2^31 groups, so no lane of one wraps; differences are taken modulo 2^32 all the same, so
that sums of many texts compare rightly as long as they differ by fewer than 2^31 groups.

Defined cases: a null text is an empty one, whose fingerprint is zero; two empty texts are alike (1.0).
Rows with equal ids follow each other by a hash of their text, null ids come first, and the last row is followed by
the first, so a table's only row is followed by itself; an empty table gives an empty one. Other
columns are not read, so names can't clash.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from quire.llm.common import map_rows, slices, table

WIDE, LANES, GROUP = 4, 128, 8
LEAST = -(1 << 63)


class Fingerprint:
    """A sum of paragraph vectors; + and - insert and delete."""

    __slots__ = ("wide", "signs")

    def __init__(self, wide: np.ndarray | None = None, signs: np.ndarray | None = None):
        self.wide = np.zeros(WIDE, np.uint64) if wide is None else wide
        self.signs = np.zeros(LANES, np.int32) if signs is None else signs

    def __add__(self, other: Fingerprint) -> Fingerprint:
        return Fingerprint(self.wide + other.wide, self.signs + other.signs)

    def __sub__(self, other: Fingerprint) -> Fingerprint:
        return Fingerprint(self.wide - other.wide, self.signs - other.signs)

    def __str__(self) -> str:
        return self.wide.astype(">u8").tobytes().hex() + self.signs.astype(">i4").tobytes().hex()

    def likeness(self, other: Fingerprint) -> float:
        """1.0 for equal multisets, about the share of common groups else."""
        if np.array_equal(self.wide, other.wide) and np.array_equal(self.signs, other.signs):
            return 1.0
        a, b = self.signs.astype(float), other.signs.astype(float)
        apart = (self.signs - other.signs).astype(float)  # modulo 2^32
        both = float(a @ a + b @ b)
        return min(1.0, max(0.0, 1.0 - float(apart @ apart) / both)) if both else 0.0


def parse(fingerprint: str) -> Fingerprint:
    raw = bytes.fromhex(fingerprint)
    return Fingerprint(np.frombuffer(raw[: 8 * WIDE], ">u8").astype(np.uint64), np.frombuffer(raw[8 * WIDE :], ">i4").astype(np.int32))


def fingerprint(text: str, seen: dict[str, tuple[bytes, bytes]] | None = None) -> Fingerprint:
    """seen keeps paragraphs' hashes for texts that share some."""
    seen = {} if seen is None else seen
    wide, groups = [], []
    for paragraph in text.split("\n"):
        if paragraph in seen:
            hashed = seen[paragraph]
        else:
            hashed = seen[paragraph] = _hashed(paragraph)
        wide.append(hashed[0])
        groups.append(hashed[1])
    total = np.frombuffer(b"".join(wide), "<u8").reshape(-1, WIDE).sum(axis=0, dtype=np.uint64)
    bits = np.frombuffer(b"".join(groups), np.uint8).reshape(-1, LANES // 8)
    signs = np.zeros(LANES, np.int64)
    for at in range(0, len(bits), 4096):
        part = np.unpackbits(bits[at : at + 4096], axis=1)
        signs += 2 * part.sum(axis=0, dtype=np.int64) - len(part)
    return Fingerprint(total, signs.astype(np.int32))


def _hashed(paragraph: str) -> tuple[bytes, bytes]:
    words = paragraph.split()
    if not words:
        return b"", b""
    data = paragraph.encode()
    groups = [hashlib.blake2b(" ".join(words[i : i + GROUP]).encode(), digest_size=LANES // 8).digest() for i in range(0, len(words), GROUP)]
    return hashlib.blake2b(data, digest_size=8 * WIDE).digest(), b"".join(groups)


def fingerprint_texts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, fingerprint."""
    kind = df.select(id_col).dtypes[0][1]
    return map_rows(df.select(id_col, text_col), lambda keys, texts: (keys, [str(fingerprint(t or "")) for t in texts]), f"`{id_col}` {kind}, fingerprint string")


def _in_order(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Rows in buckets by ranges of the id, sorted, each bucket with the row that follows it as a guard.

    The texts are shuffled once. The driver gets one key a bucket, and buckets are as many as shuffle
    partitions. An id that takes up several quantiles is split over as many buckets by a hash of the
    text. Only rows with a bucket's first key are copied, for their bucket's predecessor.
    """
    spark = df.sparkSession
    n = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    text = F.coalesce(F.col(text_col), F.lit(""))
    d = df.select(F.col(id_col).cast("long").alias("id"), text.alias("text"), F.xxhash64(text).alias("mark"))
    d = d.withColumn("key", F.coalesce("id", F.lit(LEAST)))
    cuts = np.array(sorted(int(x) for x in d.approxQuantile("key", [i / n for i in range(1, n)], 0.2 / n)) if n > 1 else [], np.int64)

    def bucket(key: pd.Series, mark: pd.Series) -> np.ndarray:
        key, share = key.to_numpy(np.int64), (mark.to_numpy(np.int64).astype(float) / 2.0**63 + 1) / 2
        low, high = np.searchsorted(cuts, key, "left"), np.searchsorted(cuts, key, "right")
        return np.where(high > low, np.minimum(low + 1 + (share * (high - low)).astype(np.int64), high), low)

    of = F.pandas_udf(lambda key, mark: pd.Series(bucket(key, mark)), "long")
    firsts = {r["b"]: tuple(r["k"]) for r in d.groupBy(of("key", "mark").alias("b")).agg(F.min(F.struct("key", "mark")).alias("k")).collect()}
    order = sorted(firsts)
    before = {firsts[b]: order[i - 1] for i, b in enumerate(order)}

    def buckets(key: pd.Series, mark: pd.Series) -> pd.Series:
        rows = zip(bucket(key, mark).tolist(), key.tolist(), mark.tolist())
        return pd.Series([[b] if (g := before.get((k, m))) is None else [b, n + g] for b, k, m in rows])

    d = d.withColumn("at", F.explode(F.pandas_udf(buckets, "array<long>")("key", "mark")))
    d = d.select("id", "text", "mark", (F.col("at") % n).alias("at"), (F.col("at") >= n).alias("guard"))
    d = d.repartitionById(n, F.col("at").cast("int")).sortWithinPartitions("at", "guard", F.col("id").asc_nulls_first(), "mark", "text")
    return d.select("id", "text", "at", "guard")


def edited_neighbours(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", share: int = 4) -> DataFrame:
    """Per row: id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    The edited text is the row's with its last n_chars // share code points replaced by the first as
    many of the next row's.
    """
    schema = T._parse_datatype_string(f"`{id_col}` long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for part in slices(batches):
            out = []
            for doc_id, text, at, guard in zip(*(c.to_pylist() for c in part.columns)):
                if guard and (held is None or held[0] != at):
                    continue  # a later copy of the same guard
                seen: dict = {}
                row = (at, doc_id, text, fingerprint(text, seen), seen)
                if held is not None and held[0] == at:
                    out.append(_compared(held, row, share))
                held = None if guard else row
            yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(list(zip(*out)) or [()] * len(arrow), arrow)], schema=arrow)

    return _in_order(df, id_col, text_col).mapInArrow(run, schema)


def _compared(row: tuple, following: tuple, share: int) -> tuple:
    _, doc_id, text, own, seen = row
    n = len(text)
    edited = text[: n - n // share] + following[2][: n // share]
    changed = fingerprint(edited, seen)
    return doc_id, n, hashlib.sha256(edited.encode()).hexdigest(), str(own), str(changed), own.likeness(changed), own.likeness(following[3])


def query(spark, sf_dir: str) -> DataFrame:
    return edited_neighbours(table(spark, sf_dir, "documents"))
