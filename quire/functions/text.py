"""Text functions as column expressions; nothing here leaves the JVM."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: White space of any kind, as strip() takes it; and that within a line.
WS = r"[\t-\r\x1c-\x20\x85\xa0\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
BLANKS = "".join(map(chr, (*range(9, 14), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)))
GAP = WS.replace(r"\t-\r", r"\t\x0b-\r")
ATTRS = r"(?:\{[^}]*\})?"
TARGET, ANCHOR = r"\([^)]*\)", r"\(#[^)]*\)"
LABEL = r"\[[^\]]*\]"
EMPTY_LINES = r"\n\n\n+"
UNITS = "B KiB MiB GiB TiB".split()
TAGS = ("br", "div", "em", "p", "span", "strong", "sub", "sup")

#: (name, text that a match must hold, (pattern, replacement) pairs), in order. Line ends are \n only. A blank
#: caption leaves a paragraph's end, any other a paragraph of its own.
RULES: tuple[tuple[str, str, tuple[tuple[str, str], ...]], ...] = (
    ("figcaption", "<figcaption>", ((f"<figcaption>{WS}*</figcaption>", "\n\n"), (f"(?s)<figcaption>{WS}*(.*?){WS}*</figcaption>", "\n\n$1\n\n"))),
    ("figure", "figure", (("</?figure[^>]*+>", ""),)),
    ("image", "![", ((rf"!\[{GAP}*\]{TARGET}{ATTRS}", "\n\n"), (rf"!\[{GAP}*([^\n]*?){GAP}*\]{TARGET}{ATTRS}", "\n\n$1\n\n"))),
    ("img", "<img", (("<img[^>]*>", ""),)),
    ("embed", "<embed", (("<embed[^>]*>", ""),)),
    ("equation_ref", "[\\[", ((rf"\[\\\[[^\]]*\\\]\]{ANCHOR}{ATTRS}", ""),)),
    ("anchor_link", "](#", ((rf"\[([^\]]+)\]{ANCHOR}{ATTRS}", "$1"),)),
    ("citation", "[@", ((r"\[@[^\]]*+\]", ""),)),
    ("fence", ":::", ((r"(?md)^:::+[^\n]*", ""),)),
    ("id_attr", "{#", ((r"\{#[^}]*+\}", ""),)),
    ("class_attr", "{.", ((r"\{\.[^}]*+\}", ""),)),
    ("key_attr", "{", ((r"\{[^{}=]*=[^{}]*\}", ""),)),
    ("tags", "<", ((f"</?(?:{'|'.join(TAGS)})[^>]*>", ""),)),
    ("empty_parens", "(", ((rf"\({WS}*[,;]?{WS}*\)", ""),)),
    ("empty_brackets", "[", ((rf"\[{WS}*\]", ""),)),
    ("space_before_sign", "", ((r"[ \t]+([),.:;])", "$1"),)),
    ("space_after_paren", "(", ((rf"\({WS}+", "("),)),
    ("blanks", "", ((r"[ \t]{2,}", " "),)),
    ("blank_lines", "\n\n\n", ((EMPTY_LINES, "\n\n"),)),
)
RESIDUE = "|".join((r"\[@", r"\{#", r"\{\.[A-Za-z]", r'\{[A-Za-z][-\w]*="', ":::", "<(?:figure|div|span)", r"\[\\\[", r"\]\(#"))
MATH = r"(?s)\$\$.{0,1998}?\$\$|\$[^$\n]+\$"


def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """body over value, which is evaluated once however often body uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def strip(c: Column) -> Column:
    """Without leading and trailing white space of any kind."""
    return F.btrim(c, F.lit(BLANKS))  # looks at the ends only, while a pattern tries every gap


def collapse(c: Column) -> Column:
    return strip(F.regexp_replace(c, f"{WS}+", " "))


def clean_target(c: Column) -> Column:
    """Image links out, line ends trimmed, blank lines collapsed; stripped, with one line end."""
    c = F.regexp_replace(c, "!" + LABEL + TARGET, "")
    c = F.regexp_replace(F.regexp_replace(c, r"[ \t]+\n", "\n"), EMPTY_LINES, "\n\n")
    return F.concat(strip(c), F.lit("\n"))


def residue_density(c: Column) -> Column:
    """Markup left over per thousand characters, counting short texts as a thousand."""
    return F.regexp_count(c, F.lit(RESIDUE)) / F.greatest(F.length(c) / 1000, F.lit(1.0))


def front_matter(c: Column) -> tuple[Column, Column]:
    """(yaml, body): split at the first line of three dashes after one at the very start."""
    end = F.locate("\n---\n", c, 5)
    has = c.startswith("---\n") & (end > 0)
    return F.when(has, F.substring(c, F.lit(5), end - 5)).otherwise(""), F.when(has, F.substring(c, end + 5, F.length(c))).otherwise(c)


def _interleave(parts: Column, between: Callable[[Column], Column]) -> Column:
    return F.array_join(F.transform(parts, lambda p, i: F.concat(p, F.when(i < F.size(parts) - 1, between(i)).otherwise(""))), "")


def protected(c: Column, body: Callable[[Column], Column]) -> Column:
    """body over c with formulas replaced by marks, which are put back afterwards by their number."""

    some = F.contains(c, F.lit("$"))
    store = F.when(some, F.regexp_extract_all(c, F.lit(MATH), F.lit(0))).otherwise(F.expr("CAST(array() AS array<string>)"))
    parts = F.when(some, F.split(c, MATH)).otherwise(F.array(c))

    def kept(s: Column) -> Column:
        masked = bind(parts, lambda p: _interleave(p, lambda i: F.concat(F.lit("\0M"), i.cast("string"), F.lit("\0"))))
        return bind(body(masked), lambda done: F.when(F.size(s) == 0, done).otherwise(_restored(done, s)))

    return bind(store, kept)


def _restored(done: Column, store: Column) -> Column:
    numbers = F.regexp_extract_all(done, F.lit("\0M([0-9]+)\0"), F.lit(1))
    return bind(numbers, lambda n: bind(F.split(done, "\0M[0-9]+\0"), lambda parts: _interleave(parts, lambda i: F.get(store, F.get(n, i).cast("int")))))


def _replaced(c: Column, pairs: tuple[tuple[str, str], ...]) -> Column:
    for pattern, new in pairs:
        c = F.regexp_replace(c, pattern, new)
    return c


def apply_rule(c: Column, name: str) -> Column:
    return _replaced(c, next(pairs for k, _, pairs in RULES if k == name))


def scrub(c: Column) -> Column:
    """All rules in order, formulas left alone; no-break spaces become spaces first. A rule is tried only
    on texts that hold what its matches must."""

    def rules(t: Column) -> Column:
        for _, needed, pairs in RULES:
            t = bind(t, lambda x: F.when(F.contains(x, F.lit(needed)), _replaced(x, pairs)).otherwise(x) if needed else _replaced(x, pairs))  # noqa: B023
        return strip(t)

    return protected(F.translate(c, "\xa0", " "), rules)


def titled(title: Column, authors: Column, body: Column) -> Column:
    """A heading and the authors before the body, each only if there is one."""
    head = F.when(F.coalesce(title, F.lit("")) != "", F.concat(F.lit("# "), title, F.lit("\n\n"))).otherwise("")
    by = F.when(F.coalesce(authors, F.lit("")) != "", F.concat(authors, F.lit("\n\n"))).otherwise("")
    return F.concat(head, by, body)


def human_bytes(n: Column) -> Column:
    value, units = n.cast("double"), UNITS
    out = F.format_string("%.2f TiB", value / 1024**4)
    for i in reversed(range(len(units) - 1)):
        out = F.when(value < 1024 ** (i + 1), F.format_string(f"%.2f {units[i]}", value / 1024**i)).otherwise(out)
    return out


def quoted_path(c: Column) -> Column:
    """Percent-encoded, slashes kept."""
    return F.replace(F.replace(F.replace(F.url_encode(c), F.lit("%2F"), F.lit("/")), F.lit("+"), F.lit("%20")), F.lit("*"), F.lit("%2A"))


def preview(c: Column, n: int = 120) -> Column:
    return F.translate(F.substring(c, 1, n), "\n", " ")


def csv_items(c: Column) -> Column:
    return F.filter(F.transform(F.split(c, ","), lambda x: F.trim(x)), lambda x: x != "")


def locator(c: Column) -> tuple[Column, Column]:
    """(chunk, member) of `pdf_tarballs/<chunk>.tar.gz:<member>`, empty where it isn't one."""
    p = r"pdf_tarballs/" + r"([^:]+)\.tar\.gz:" + "(.+)$"
    return F.regexp_extract(c, p, 1), F.regexp_extract(c, p, 2)


def glob_pattern(glob: str) -> str:
    """A shell pattern as a regular expression for rlike; `*` crosses slashes."""
    import re

    out = "".join(".*" if c == "*" else "." if c == "?" else re.escape(c) for c in glob)
    return f"(?s)^{out}$"


def money(c: Column) -> Column:
    """Two decimals, rounded by the exact binary value, ties to even; format_string rounds what is shown.

    For values under 2^53. A fraction of 2^-8 or more is a whole number of 2^-60; smaller ones round to 0.
    Under 2^30 a hundred times the value is off by 2^-16 at most, so unless that is near a half cent, its
    nearest whole number is right; only the rest take exact decimals.
    """
    unit = F.lit(1 << 60).cast("decimal(20,0)")

    def parts(x: Column) -> Column:
        whole = F.floor(x)
        part = F.floor(F.when(x - whole < 2.0**-8, F.lit(0.0)).otherwise((x - whole) * float(1 << 60))).cast("decimal(20,0)") * 100
        return F.struct(whole.alias("whole"), part.alias("part"), F.call_function("div", part, unit).alias("cents"))

    def rounded(p: Column) -> Column:
        rest, half, total = p["part"] - p["cents"] * unit, F.lit(1 << 59).cast("decimal(20,0)"), p["whole"] * 100 + p["cents"]
        return (total + F.when((rest > half) | (rest == half) & (total % 2 == 1), 1).otherwise(0)).cast("long")

    def cents(x: Column) -> Column:
        near = F.floor(x * 100.0 + 0.5)
        sure = (x < float(1 << 30)) & (F.abs(x * 100.0 - near) < 0.499)
        return F.when(sure, near).otherwise(bind(parts(x), rounded))

    def shown(v: Column) -> Column:
        sign = F.when(v.cast("string").startswith("-"), "-").otherwise("")
        digits = bind(bind(F.abs(v), cents), lambda t: F.concat(F.call_function("div", t, F.lit(100)).cast("string"), F.lit("."), F.lpad((t % 100).cast("string"), 2, "0")))
        return F.when(~F.isnan(v), F.concat(sign, digits))

    return bind(c, shown)


def _heads(texts: pd.Series) -> pd.DataFrame:
    from quire.sources.yaml import parse_yaml

    def fields(text: str) -> dict:
        try:
            found = parse_yaml(text)
        except ValueError:
            return {}
        return found if isinstance(found, dict) else {}

    found = [fields(t or "") for t in texts]
    keep = lambda v: v if isinstance(v, str) else None
    return pd.DataFrame({"title": [keep(f.get("title")) for f in found], "abstract": [keep(f.get("abstract")) for f in found]})


def clean_documents(df: DataFrame, text: str, authors: str | None = None) -> DataFrame:
    """df with its front matter's title as heading, and abstract and body scrubbed together."""
    yaml, body = front_matter(F.col(text))
    d = df.withColumns({"_head": F.pandas_udf(_heads, "title string, abstract string")(yaml), "_body": body})
    by = F.col(authors) if authors else F.lit(None).cast("string")
    whole = F.concat(F.coalesce(F.concat("_head.abstract", F.lit("\n\n")), F.lit("")), "_body")
    d = d.withColumn("_body", scrub(whole))
    return d.withColumn(text, F.concat(titled(F.col("_head.title"), by, F.col("_body")), F.lit("\n"))).drop("_head", "_body")
