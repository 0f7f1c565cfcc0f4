"""Sequence layout, masks and schedules as array expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quire.schema import IGNORE, IMAGE_TOKEN, IMAGE_TOKEN_ID


def queries_per_side(size: Column) -> Column:
    """Image tokens along a side: patches of 16, four to one, rounded up."""
    return F.floor((F.floor(size / 16) + 3) / 4)


def base_tokens(size: Column) -> Column:
    return bound(queries_per_side(size))


def bound(q: Column) -> Column:
    return (q + 1) * q + 1


def tiled_tokens(base: Column, tile: Column, w: Column, h: Column) -> Column:
    q = queries_per_side(tile)
    return base_tokens(base) + F.when((w > 1) | (h > 1), (q * w + 1) * (q * h)).otherwise(0)


def layout(q: Column, rows: Column) -> Column:
    """Ids of rows lines of q image tokens, each with a line mark, which is an image token too."""
    line = F.array_repeat(F.lit(IMAGE_TOKEN_ID), (q + 1).cast("int"))
    return F.flatten(F.array_repeat(line, rows.cast("int")))


def encoded_size(text: Column, run: int) -> Column:
    """Ids of a text: a start id, a run of image ids for each mark, and one for each other code point."""
    marks = (F.length(text) - F.length(F.replace(text, F.lit(IMAGE_TOKEN), F.lit("")))) / len(IMAGE_TOKEN)
    return F.length(text) + 1 + marks.cast("int") * (run - len(IMAGE_TOKEN))


def first_supervised(labels: Column) -> Column:
    at = F.array_position(F.transform(labels, lambda x: x != IGNORE), True)
    return F.coalesce(F.nullif(at, F.lit(0)) - 1, F.size(labels).cast("long"))


def visible(q: Column, boundary: Column, window: int, real: Column) -> Column:
    """Positions that position q sees: the reference before boundary, and the last window up to itself."""
    q, boundary = q.cast("int"), boundary.cast("int")
    first = F.greatest(q - (window - 1), F.lit(0))
    apart = F.concat(F.when(boundary > 0, F.sequence(F.lit(0), boundary - 1)).otherwise(F.expr("CAST(array() AS array<int>)")), F.sequence(first, q))
    near = F.when(boundary < first, apart).otherwise(F.sequence(F.lit(0), q))
    return F.filter(near, lambda k: F.get(real, k))


def learning_rate(step: Column, peak: float, warmup: int, total: int) -> Column:
    down = 0.5 * (1 + F.cos(F.pi() * (step - warmup) / (total - warmup)))
    return peak * F.when(step < warmup, step / warmup).otherwise(down)


def page_index(page: Column, pages: Column) -> Column:
    """A one-based page number as an index within pages; 0 and null are the first page."""
    return F.when(pages <= 1, F.lit(0)).otherwise(F.least(F.greatest(F.coalesce(F.nullif(page, F.lit(0)), F.lit(1)) - 1, F.lit(0)), pages - 1))
