"""Line-first cleaning with DataFrame functions only.

Every line is judged by punctuation, navigation and boilerplate rules; lines that fail go, then a
document goes if too much of its text went with them, or if it is too short or repeats itself.

Defined cases: a null text is an empty one (no words, so it fails); null ids, ties and repeated rows
each give their own row; an empty table gives an empty one; other columns of the input are not read,
so their names can't clash. Nothing is shuffled: a document's arrays live in its own row.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SPACES = "\t\n\x0b\f\r"
SYMBOLS = "#*$%&|<>"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WINDOW = 8
#: Both ignore the case of A-Z only. A line of navigation has a word of it first, and other words only behind
#: a separator. Each part takes all it can (the + in Java; RE2 needs no mark), so lines of any length take
#: linear time.
NAVIGATION = (
    r"^[^a-z]*{all}(home|menu|search|log ?in|log ?out|sign ?in|sign ?up|register|subscribe|next( page)?|prev(ious)?( page)?|back to top|"
    r"share( this)?|skip to (main )?content|read more|contact( us)?|about( us)?|site ?map|faq|help|top)"
    r"( *[|>/][a-z |>/]*{all})?[^a-z]*{all}$"
)
BOILERPLATE = (
    r"all rights reserved|(accept|use|uses|of|our) cookies|cookie policy|enable javascript|javascript is (disabled|required)|"
    r"privacy policy|terms of (use|service)|lorem ipsum|click here|powered by [a-z]+"
)
#: One of these is in every text that has boilerplate.
BOILERPLATE_PARTS = ("rights reserved", "cookie", "javascript", "privacy policy", "terms of", "lorem ipsum", "click here", "powered by")


def line_first_clean(
    df: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    max_loss: float = 0.5,
    min_words: int = 20,
    max_repeat: float = 0.3,
    symbols_per_word: float = 0.3,
    shouts_per_word: float = 0.5,
    bare_words: int = 10,
) -> DataFrame:
    """Per document: id, clean_text, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
    lost_chars, base_failed, kept.

    A line fails if it has symbols_per_word symbols a word (three at least), shouts_per_word
    exclamation marks a word (three at least), bare_words words or more and no punctuation at all, or
    if it is navigation or boilerplate. Windows are compared by a 64-bit hash of their words' hashes.
    """
    return _cleaned(df.select(F.col(id_col), F.coalesce(F.col(text_col), F.lit("")).alias("t")), [id_col], max_loss, min_words, max_repeat, symbols_per_word, shouts_per_word, bare_words)


def clean_documents(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", **rules) -> DataFrame:
    """The rows of df that are kept, with their cleaned texts; all other columns, whatever their names,
    pass through."""
    packed = df.select(F.struct(*(F.col(f"`{c}`") for c in df.columns)).alias("row"), F.coalesce(F.col(text_col), F.lit("")).alias("t"))
    settings = {"max_loss": 0.5, "min_words": 20, "max_repeat": 0.3, "symbols_per_word": 0.3, "shouts_per_word": 0.5, "bare_words": 10} | rules
    d = _cleaned(packed, ["row"], **settings).where("kept")
    return d.select(*(F.col("clean_text").alias(c) if c == text_col else F.col("row").getField(c).alias(c) for c in df.columns))


def _cleaned(d: DataFrame, carried: list[str], max_loss: float, min_words: int, max_repeat: float, symbols_per_word: float, shouts_per_word: float, bare_words: int) -> DataFrame:
    low = F.lower("t")  # of letters outside A-Z too, but lines are judged exactly below
    d = d.select(
        *carried,
        "t",
        F.array_remove(F.split("t", r"[\x20\x09-\x0D]+"), "").alias("w"),
        F.regexp_count("t", F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
        F.filter(F.split("t", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias("worded"),
        F.contains("t", F.lit("!")).alias("shouts"),
        reduce(or_, (F.contains(low, F.lit(x)) for x in BOILERPLATE_PARTS)).alias("boiler"),
    )
    d = d.withColumn("wh", F.when(F.size("w") >= WINDOW, F.transform("w", lambda x: F.xxhash64(x))))
    judged = lambda line: _fails(line, F.col("n_symbols") >= 3, F.col("shouts"), F.col("boiler"), symbols_per_word, shouts_per_word, bare_words)
    d = d.select(
        *carried,
        "t",
        F.length(F.array_join("w", "")).cast("long").alias("word_chars"),
        "n_symbols",
        "worded",
        F.size("w").cast("long").alias("n_words"),
        (F.size("worded") - F.size(F.array_distinct("worded"))).cast("long").alias("n_dup_lines"),
        F.when(F.col("wh").isNotNull(), F.transform(F.sequence(F.lit(1), F.size("w") - (WINDOW - 1)), lambda i: F.xxhash64(F.slice("wh", i, WINDOW)))).alias("h"),
        F.transform("worded", judged).alias("bad"),
    )
    again = F.col("h").isNotNull() & (F.size(F.array_distinct("h")) < F.size("h"))
    d = d.withColumn("s", F.when(again, F.sort_array(F.transform("h", lambda x, i: F.struct(x.alias("x"), i.alias("i"))))))
    twin = lambda e, k: (F.get("s", k - 1)["x"] == e["x"]) | (F.get("s", k + 1)["x"] == e["x"])
    d = d.withColumn("p", F.when(F.col("s").isNotNull(), F.sort_array(F.transform(F.filter("s", lambda e, k: F.coalesce(twin(e, k), F.lit(False))), lambda e: e["i"]))))
    covered = F.transform("p", lambda q, k: F.least(F.lit(WINDOW), F.coalesce(F.get("p", k + 1) - q, F.lit(WINDOW))))
    d = d.select(
        *carried,
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        F.when(F.col("p").isNotNull(), F.aggregate(covered, F.lit(0).cast("long"), lambda a, x: a + x)).otherwise(F.lit(0)).cast("long").alias("n_repeat_words"),
        F.when(F.array_contains("bad", True), F.length(F.translate(F.array_join(F.filter("worded", lambda x, i: F.get("bad", i)), ""), " " + SPACES, ""))).otherwise(0).cast("long").alias("lost_chars"),
        F.when(F.array_contains("bad", True), F.array_join(F.filter("worded", lambda x, i: ~F.get("bad", i)), "\n")).otherwise(F.col("t")).alias("clean_text"),
    )
    # A filter that the optimizer moves below these steps would repeat their expressions in itself,
    # again and again. It can't be moved below the making of an id, on which the columns depend here.
    d = d.withColumn("at", F.monotonically_increasing_id())
    held = (F.when(F.col("at") >= 0, F.col(c)).alias(c) for c in ("n_repeat_words", "lost_chars", "clean_text"))
    d = d.select(*carried, "n_words", "word_chars", "n_symbols", "n_dup_lines", *held)
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > F.lit(round(100 * max_repeat)) * F.col("n_words"))
    return d.withColumn("base_failed", failed).withColumn("kept", ~F.col("base_failed") & (F.col("lost_chars") <= F.col("word_chars") * F.lit(max_loss)))


def _fails(line, symbols, shouts, boiler, symbols_per_word: float, shouts_per_word: float, bare_words: int):
    """Whether a line fails. symbols, shouts and boiler say if the text has any: cheap tests come first."""
    words = F.size(F.array_remove(F.split(line, r"[\x20\x09-\x0D]+"), ""))
    count = lambda of: F.regexp_count(line, F.lit(of))
    many = lambda of, share: (count(of) >= 3) & (count(of) >= words * F.lit(share))
    return (
        (symbols & many(r"[#*$%&|<>]", symbols_per_word))
        | (shouts & many("!", shouts_per_word))
        | (~reduce(or_, (F.contains(line, F.lit(x)) for x in ".,;:!?")) & (words >= bare_words))
        | line.rlike("(?i)" + NAVIGATION.replace("{all}", "+"))
        | (boiler & line.rlike("(?i)" + BOILERPLATE))
    )


def query(spark, sf_dir: str) -> DataFrame:
    from quire.llm.common import table

    d = line_first_clean(table(spark, sf_dir, "documents"))
    return d.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


_WS = r"chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
ORACLE = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
b AS (
  SELECT doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w,
         length(translate(t, ' ' || {_WS}, '')) AS word_chars,
         length(t) - length(translate(t, '{SYMBOLS}', '')) AS n_symbols,
         list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ln
  FROM d),
win AS (
  SELECT doc_id, i, array_to_string(w[i:i + {WINDOW - 1}], ' ') AS g
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - {WINDOW - 2})) AS i FROM b WHERE len(w) >= {WINDOW})),
rep AS (SELECT doc_id, i FROM win QUALIFY count(*) OVER (PARTITION BY doc_id, g) > 1),
cov AS (SELECT doc_id, least({WINDOW}, coalesce(lead(i) OVER (PARTITION BY doc_id ORDER BY i) - i, {WINDOW})) AS c FROM rep),
r AS (SELECT doc_id, sum(c) AS n FROM cov GROUP BY doc_id),
lines AS (
  SELECT doc_id, l, translate(l, '{UPPER}', '{LOWER}') AS low, len(regexp_extract_all(l, '[^\x20\x09-\x0D]+')) AS nw,
         length(l) - length(translate(l, '{SYMBOLS}', '')) AS sy, length(l) - length(translate(l, '!', '')) AS ex,
         length(l) - length(translate(l, '.,;:!?', '')) AS pu
  FROM (SELECT doc_id, unnest(ln) AS l FROM b)),
lost AS (
  SELECT doc_id, sum(length(translate(l, ' ' || {_WS}, ''))) AS n FROM lines
  WHERE (sy >= 3 AND sy >= nw * 0.3) OR (ex >= 3 AND ex >= nw * 0.5) OR (nw >= 10 AND pu = 0)
     OR regexp_matches(low, '{NAVIGATION.replace("{all}", "")}') OR regexp_matches(low, '{BOILERPLATE}')
  GROUP BY doc_id),
f AS (
  SELECT b.doc_id, len(w) AS n_words, word_chars, n_symbols, len(ln) - len(list_distinct(ln)) AS n_dup_lines,
         coalesce(r.n, 0) AS n_repeat_words, coalesce(lost.n, 0) AS lost
  FROM b LEFT JOIN r USING (doc_id) LEFT JOIN lost USING (doc_id))
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols,
       n_dup_lines::BIGINT AS n_dup_lines, n_repeat_words::BIGINT AS n_repeat_words,
       (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AS base_failed,
       NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AND lost <= word_chars * 0.5 AS kept
FROM f
"""
