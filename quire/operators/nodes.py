"""Cleaning of parsed markup. A document's nodes are an array in reading order of structs (type, target,
text, caption, attr, within), where within has the positions of all nodes that a node stands in."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NODES = "array<struct<type string, target string, text string, caption string, attr string, within array<int>>>"
#: These go with all that they hold.
DROPPED = ("Cite", "RawInline", "RawBlock", "Note")
#: These leave what they hold.
UNWRAPPED = ("Link", "Span", "Div")
#: Of these only the caption stays.
CAPTIONED = ("Image", "Figure")


def clean_nodes(nodes: Column) -> Column:
    """Citations, raw parts, notes and links within the text go with all that they hold; other links, spans
    and divs leave what they hold, at any depth; images and figures leave their caption, as a text where
    they stood, or nothing; headers lose their attributes. Other nodes stay. within isn't kept: what is
    left is in reading order."""
    gone = lambda n: n["type"].isin(*DROPPED) | (n["type"] == "Link") & n["target"].startswith("#")
    closed = lambda n: F.coalesce(gone(n), F.lit(False)) | n["type"].isin(*CAPTIONED)
    # positions of nodes whose inside isn't read
    shut = F.filter(F.transform(nodes, lambda n, i: F.when(closed(n), i)), lambda i: i.isNotNull())
    bare = lambda n: n["type"].isin(*CAPTIONED) & (F.coalesce(n["caption"], F.lit("")) == "")
    seen = lambda n: ~F.coalesce(gone(n) | bare(n), F.lit(False)) & ~n["type"].isin(*UNWRAPPED) & ~F.arrays_overlap(n["within"], shut)
    made = lambda n: F.struct(
        F.when(n["type"].isin(*CAPTIONED), "Para").otherwise(n["type"]).alias("type"),
        F.when(n["type"].isin(*CAPTIONED), n["caption"]).otherwise(n["text"]).alias("text"),
        F.when(~n["type"].isin("Header", *CAPTIONED), n["attr"]).alias("attr"),
    )
    return F.transform(F.filter(nodes, seen), made)


def with_abstract(abstract: Column, blocks: Column) -> Column:
    """The cleaned nodes of an abstract, if there is one, before those of the text; nothing else of a
    document's metadata stays."""
    return F.when(abstract.isNull(), blocks).otherwise(F.concat(abstract, blocks))
