"""Personal data: base detectors, and bootstrapped contextual extraction of what they miss.

The base spans are the seeds. Their contexts, the one and the two words before them, are lexical
patterns; so are those of candidates, texts that look like an identifier but are no base span: numbers of
7 to 19 digits, addresses with `at` and `dot` spelt in brackets, IPv4 addresses with their points so
bracketed, and IPv6 ones. Words are runs of letters, here and where patterns are counted, so `tel:` is the
word `tel`. Spark holds the graph of patterns and instances (normalised values) and scores it in rounds,
until nothing new becomes known: a pattern's confidence for a kind is the known instances' share of all
places where its words stand in the whole corpus, and it needs MIN_SUPPORT different known values; an
instance becomes known if one of its patterns reaches MIN_CONFIDENCE. Candidates behind such patterns are
added to the spans.

A pattern is counted over the corpus only if enough values stand behind it. The tasks get these
patterns as a bit set of fixed size (BITS), whose false hits a join removes, so what is broadcast doesn't
grow with the data. Spans are found, and redacted, by joins with the confident patterns themselves.
Graph rows are a candidate or seed each, and are reduced by sums with map-side combination.

Defined cases: a null text is an empty one (no spans); each row, repeated or with a null id, gives its
own row; an empty table gives an empty one; other columns are not read, so names can't clash.
"""

from __future__ import annotations

import re
import zlib
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from quire.llm.common import slices, table, written

KINDS = ("email", "ip", "card", "phone")
MIN_SUPPORT, MIN_CONFIDENCE, BITS = 5, 0.8, 1 << 20
#: Digits that a candidate number has: those of a local phone number to those of the longest card.
DIGITS = range(7, 20)

LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
#: Identifier-like text that base detectors may have passed over. None of these reads a text's part twice.
NUMBER = re.compile(r"(?<![\w.])[+(]?[0-9](?:[\x20().:/-]{0,2}[0-9])++")
SPELT_AT = re.compile(r"(?i) ?[\[(] ?at ?[\])] ?")
SPELT_DOMAIN = re.compile(r"(?i)[a-z0-9-]++(?: ?(?:\.|[\[(] ?dot ?[\])]) ?[a-z0-9-]++)+")
SPELT_IP = re.compile(r"(?i)(?<![\w.])[0-9]{1,3}(?: ?[\[(] ?(?:\.|dot) ?[\])] ?[0-9]{1,3}){3}(?![\w.])")
WIDE_IP = re.compile(r"(?<![\w:.])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![\w:])")
WORD = re.compile(r"[^\W\d_]+")


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches of local@domain: the local part is the whole run before an at sign."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in LOCAL:
            start -= 1
        if start < at and (m := DOMAIN.match(text, at)):
            yield start, m.end()
            done = m.end()
        at = text.find("@", max(at + 1, done))


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) in code points, by kind as listed, then start."""
    found = [("email", a, b) for a, b in _emails(text)]
    for m in IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p[-3:] if len(p) > 3 else p) <= 255 and not p[:-3].strip("0") for p in m.group().split(".")):
            found.append(("ip", *m.span()))
    for m in CARD.finditer(text):
        if m.end() - m.start() <= 64:
            digits = m.group().replace(" ", "").replace("-", "")
            if 13 <= len(digits) <= 19 and luhn(digits):
                found.append(("card", *m.span()))
    if "+" in text:
        for m in PHONE.finditer(text):
            if 9 <= sum(map(str.isdigit, m.group())) <= 15:
                found.append(("phone", *m.span()))
    return found


def _numbers(text: str) -> Iterator[tuple[str, int, int]]:
    for m in NUMBER.finditer(text):
        start, end = m.span()
        if end < len(text) and (text[end].isalnum() or text[end] == "_"):  # its last digits belong to a word
            while end > start and text[end - 1].isdigit():
                end -= 1
            while end > start and not text[end - 1].isdigit():
                end -= 1
        digits = sum(map(str.isdigit, text[start:end]))
        if digits in DIGITS:
            yield "card" if digits > 12 else "phone", start, end


def _spelt_emails(text: str) -> Iterator[tuple[str, int, int]]:
    done = 0
    for m in SPELT_AT.finditer(text):
        start = m.start()
        while start > done and text[start - 1] in LOCAL:
            start -= 1
        if start < m.start() and (domain := SPELT_DOMAIN.match(text, m.end())):
            yield "email", start, domain.end()
            done = domain.end()


def _candidates(text: str, taken: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    out = []
    if "[" in text or "(" in text:
        out += _spelt_emails(text)
        out += [("ip", *m.span()) for m in SPELT_IP.finditer(text)]
    if text.count(":") >= 7:
        out += [("ip", *m.span()) for m in WIDE_IP.finditer(text)]
    out = _outside(out, taken)
    return out + _outside(list(_numbers(text)), taken + out)


def _outside(found: list[tuple[str, int, int]], taken: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    """The places of found that overlap none of the taken ones."""
    if not found or not taken:
        return found
    starts, ends = [], []  # of the taken places, joined where they overlap
    for a, b in sorted((a, b) for _, a, b in taken):
        if ends and a <= ends[-1]:
            ends[-1] = max(ends[-1], b)
        else:
            starts.append(a)
            ends.append(b)
    free = lambda a, b: not (i := bisect_left(starts, b)) or ends[i - 1] <= a
    return [x for x in found if free(x[1], x[2])]


def _value(kind: str, text: str) -> str:
    if kind == "email":
        return text.lower()
    return "".join(c for c in text.lower() if c.isdigit() or kind == "ip" and c in "abcdef:")


def _contexts(text: str, starts: list[int]) -> list[list[str]]:
    """For each place that begins at one of starts: the word before it, and the two words."""
    if not starts:
        return []
    words = [(m.end(), m.group().lower()) for m in WORD.finditer(text, 0, max(starts))]
    ends = [end for end, _ in words]
    out = []
    for start in starts:
        n = bisect_right(ends, start)
        if n and n == len(ends) and ends[-1] == start and start < len(text) and WORD.match(text[start]):
            n -= 1  # the place begins within a word
        before = [w for _, w in words[max(0, n - 2) : n]]
        out.append([" ".join(before[-k:]) for k in (1, 2) if len(before) >= k])
    return out


def _bit(pattern: str) -> int:
    return zlib.crc32(pattern.encode()) % BITS


def scan_texts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: row (unique), id, base spans, and instances: every seed's and candidate's place and patterns."""
    kind = df.select(id_col).dtypes[0][1]
    span = "struct<kind string, start long, end long>"
    schema = T._parse_datatype_string(f"row long, `{id_col}` {kind}, base array<{span}>, instances array<struct<kind string, start long, end long, seed boolean, value string, patterns array<string>>>")
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = TaskContext.get().partitionId() << 40
        for part in slices(batches):
            base, instances = [], []
            for text in part.column(1).to_pylist():
                text = text or ""
                seeds = base_spans(text)
                every = seeds + _candidates(text, seeds)
                base.append([dict(zip(("kind", "start", "end"), s)) for s in seeds])
                instances.append(
                    [
                        {"kind": k, "start": a, "end": b, "seed": i < len(seeds), "value": _value(k, text[a:b]), "patterns": before}
                        for i, ((k, a, b), before) in enumerate(zip(every, _contexts(text, [a for _, a, _ in every])))
                    ]
                )
            n = part.num_rows
            columns = [pa.array(range(row, row + n), pa.int64()), part.column(0), pa.array(base, arrow.field(2).type), pa.array(instances, arrow.field(3).type)]
            row += n
            yield pa.RecordBatch.from_arrays(columns, schema=arrow)

    return df.select(id_col, text_col).mapInArrow(run, schema)


def count_patterns(df: DataFrame, text_col: str, bits: bytes) -> DataFrame:
    """(pattern, total): the places of one- and two-word patterns that the bit set may hold."""
    shared = df.sparkSession.sparkContext.broadcast(bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flags = np.unpackbits(np.frombuffer(shared.value, np.uint8), bitorder="little")
        known: dict[str, str | None] = {}  # a word in lower case, or None if it isn't marked
        for part in slices(batches):
            found: Counter = Counter()
            if len(known) > 300_000:
                known.clear()
            for text in part.column(0).to_pylist():
                words = WORD.findall(text or "")
                # a two-word pattern counts only behind a last word that is itself marked
                for i, w in enumerate(words):
                    if w in known:
                        hit = known[w]
                    else:
                        low = w.lower()
                        hit = low if flags[_bit(low)] else None
                        if len(w) < 64:
                            known[w] = hit
                    if hit is not None:
                        found[hit] += 1
                        if i:
                            found[f"{words[i - 1].lower()} {hit}"] += 1
            rows = [(p, n) for p, n in found.items() if " " not in p or flags[_bit(p)]]
            yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in rows], pa.string()), pa.array([n for _, n in rows], pa.int64())], names=["pattern", "n"])

    return df.select(text_col).mapInArrow(run, "pattern string, n long").groupBy("pattern").agg(F.sum("n").alias("total"))


def confident_patterns(scanned: DataFrame, df: DataFrame, text_col: str = "text", min_support: int = MIN_SUPPORT, min_confidence: float = MIN_CONFIDENCE) -> DataFrame:
    """(kind, pattern, confidence) of the patterns that reach min_confidence when nothing new becomes known.

    What is known only grows, so the rounds end; the driver gets a count a round.
    """
    spark = df.sparkSession
    places = scanned.select(F.explode("instances").alias("i")).select("i.kind", "i.value", "i.seed", F.explode("i.patterns").alias("pattern"))
    edges = places.groupBy("kind", "pattern", "value").agg(F.count("*").alias("n"), F.max("seed").alias("seed"))
    # a two-word pattern needs its last word's pattern, which stands before at least the same values
    wide = edges.groupBy("kind", "pattern").agg(F.count("*").alias("values")).where(F.col("values") >= min_support).select("kind", "pattern")
    edges = written(edges.hint("merge").join(wide, ["kind", "pattern"]), "edges")  # sized as the texts they were exploded from
    marks = edges.select((F.crc32(F.col("pattern").cast("binary")) % BITS).alias("bit")).distinct()
    bits = np.zeros(BITS, np.uint8)
    for (bit,) in marks.toLocalIterator():  # at most BITS numbers
        bits[bit] = 1
    if bits.any():
        totals = written(count_patterns(df, text_col, np.packbits(bits, bitorder="little").tobytes()), "totals")
    else:
        totals = spark.createDataFrame([], "pattern string, total long")
    known = written(edges.where("seed").select("kind", "value").distinct(), "known")
    count, scores = known.count(), None
    while True:
        held = edges.join(known, ["kind", "value"]).groupBy("kind", "pattern").agg(F.sum("n").alias("held"), F.count("*").alias("support"))
        held = held.where(F.col("support") >= min_support).join(totals, "pattern").select("kind", "pattern", F.least(F.lit(1.0), F.col("held") / F.col("total")).alias("confidence"))
        scores = written(held.where(F.col("confidence") >= min_confidence), "scores", *([scores] if scores else []))
        known = written(known.unionByName(edges.join(scores, ["kind", "pattern"]).select("kind", "value")).distinct(), "known", known)
        before, count = count, known.count()
        if count == before:
            return scores


def discovered(scanned: DataFrame, scores: DataFrame) -> DataFrame:
    """(row, more): the candidates' spans that stand behind a confident pattern."""
    places = scanned.select("row", F.explode("instances").alias("i")).where("NOT i.seed").select("row", "i.kind", "i.start", "i.end", F.explode("i.patterns").alias("pattern"))
    more = places.join(scores.select("kind", "pattern"), ["kind", "pattern"]).select("row", F.struct("kind", "start", "end").alias("s"))
    return more.groupBy("row").agg(F.collect_set("s").alias("more"))  # a row's own spans


def find_pii(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: row, id, base (spans), spans (base and discovered ones, by kind as listed, then start)."""
    scanned = written(scan_texts(df, id_col, text_col), "scanned")
    more = discovered(scanned, confident_patterns(scanned, df, text_col))
    rank = lambda s: F.struct(F.array_position(F.array(*map(F.lit, KINDS)), s["kind"]).alias("k"), s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))
    d = scanned.select("row", id_col, "base").join(more, "row", "left")
    every = F.array_sort(F.transform(F.concat("base", F.coalesce("more", F.expr("CAST(array() AS array<struct<kind string, start bigint, end bigint>>)"))), rank))
    return d.select("row", id_col, "base", F.transform(every, lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"))).alias("spans"))


def redact(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of df with every span of personal data replaced by its kind in brackets.

    Patterns are learned from the whole corpus first, and the spans behind them are found as find_pii does.
    The rows are written with a number, by which these spans are joined; base spans are searched again.
    """
    number, more_col = (next(f"{n}{i}" for i in range(len(df.columns) + 1) if f"{n}{i}" not in df.columns) for n in ("number", "more"))
    rows = written(df.withColumn(number, F.monotonically_increasing_id()), "rows")
    scanned = written(scan_texts(rows, number, text_col), "scanned")
    more = discovered(scanned, confident_patterns(scanned, rows, text_col)).join(scanned.select("row", number), "row")
    more = written(more.select(number, written_out("more").alias(more_col)), "more")
    # the copied side is broadcast only where all of it is small
    few = more.agg(F.count("*").alias("n"), F.sum(F.length(more_col)).alias("size")).first()
    small = few["n"] <= 20_000 and (few["size"] or 0) <= 4 << 20

    def clean(texts: pd.Series, more: pd.Series) -> pd.Series:
        return pd.Series([t if t is None else _redacted(t, m) for t, m in zip(texts, more)], dtype=object)

    d = rows.join(F.broadcast(more) if small else more, number, "left")
    return d.withColumn(text_col, F.pandas_udf(clean, "string")(F.col(text_col), F.col(more_col))).select(*(f"`{c}`" for c in df.columns))


def _redacted(text: str, more: str | None) -> str:
    """more: further spans as written_out writes them."""
    spans = base_spans(text)
    spans += [(k, int(a), int(b)) for k, a, b in (s.split(":") for s in (more or "").split(",") if s)]
    out, done = [], 0
    for start, end, kind in sorted((a, b, k) for k, a, b in spans):
        if end <= done:
            continue
        if start >= done:  # else it goes on from the span before
            out += [text[done:start], f"[{kind.upper()}]"]
        done = end
    return "".join(out) + text[done:] if out else text


def written_out(spans: str):
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def query(spark, sf_dir: str) -> DataFrame:
    d = find_pii(table(spark, sf_dir, "documents"))
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return d.select("doc_id", *map(count, KINDS), F.sha2(written_out("base").cast("binary"), 256).alias("base_sha256"), written_out("spans").alias("spans"))
