"""Token sequences of whole texts, as arrays in Python: each sample is encoded once, and what is made of it
takes a few passes over its ids."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from itertools import repeat
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from quire.batches import slices, small_batches
from quire.schema import IGNORE, IMAGE_TOKEN, IMAGE_TOKEN_ID

#: Positions whose strings are made at once.
CHUNK = 1 << 14


class Sample(NamedTuple):
    ids: np.ndarray
    labels: np.ndarray
    images: int
    prompt_len: int


def encoded(text: str, run: int) -> tuple[np.ndarray, np.ndarray]:
    """Code points as ids, with the flag of an image: a start id, and a run of image ids for each mark."""
    ids, image = [np.zeros(1, np.int32)], [np.zeros(1, bool)]
    for i, part in enumerate(text.split(IMAGE_TOKEN)):
        if i:
            ids.append(np.full(run, IMAGE_TOKEN_ID, np.int32))
            image.append(np.ones(run, bool))
        ids.append(np.frombuffer(part.encode("utf-32-le"), np.int32))
        image.append(np.zeros(len(ids[-1]), bool))
    return np.concatenate(ids), np.concatenate(image)


def sample(prompt: str | None, text: str | None, run: int) -> Sample | None:
    """The prompt's length is that of the prompt alone, encoded again; its ids and the images' are ignored."""
    if prompt is None or text is None:
        return None
    (ids, image), n = encoded(prompt + text, run), len(encoded(prompt, run)[0])
    labels = np.where(image, np.int32(IGNORE), ids)
    labels[:n] = IGNORE
    return Sample(ids, labels, int(image.sum()), n)


class _Names(dict):
    """Decimals of numbers."""

    def __missing__(self, x: int) -> str:
        if len(self) >= 1 << 16:
            return str(x)
        self[x] = name = str(x)
        return name


NAMES = _Names()


def joined(ids: np.ndarray) -> str:
    return ",".join(map(NAMES.__getitem__, ids.tolist()))


def first_supervised(labels: np.ndarray) -> int:
    at = np.flatnonzero(labels != IGNORE)[:1]
    return int(at[0]) if len(at) else len(labels)


def _seen(real: np.ndarray, bound: int, window: int, start: int, end: int) -> str:
    """What positions from start up to end see, joined by semicolons."""
    out, at = [], start
    while at < min(end, bound + window - 1):  # up to here nothing lies between the reference and the window
        out.append(",".join(map(str, np.flatnonzero(real[: at + 1]).tolist())))
        at += 1
    if at < end:
        head = ",".join(map(str, np.flatnonzero(real[:bound]).tolist()))
        first = at - window + 1
        own = [f",{k}" if r else "" for k, r in enumerate(real[first:end].tolist(), first)]
        rows = map("".join, zip(repeat(head), *(own[i : i + end - at] for i in range(window))))
        out.extend(rows if head else (r[1:] for r in rows))
    return ";".join(out)


def visible_digests(samples: list[Sample | None], window: int) -> list[str | None]:
    """SHA-256 of what each position sees: the real ids before the first supervised one, and the last
    window up to itself. Samples whose ids are real at the same places up to the shorter's end begin alike,
    so they share one pass, and each takes the digest at its own end."""
    found: list[str | None] = [None] * len(samples)
    groups: dict[tuple, list[tuple[int, int]]] = {}
    reals = {}
    for i, s in enumerate(samples):
        if s is not None:
            reals[i] = real = s.ids != 0
            gaps = np.flatnonzero(~real)
            # the start id is never real; a sample with other such ids goes by itself
            groups.setdefault((first_supervised(s.labels), i if len(gaps) > 1 else -1), []).append((len(real), i))
    for (bound, _), members in groups.items():
        members.sort()
        real, at, digest = reals[members[-1][1]], 0, hashlib.sha256()
        for n, i in members:
            while at < n:
                end = min(n, at + CHUNK)
                digest.update(((";" if at else "") + _seen(real, bound, window, at, end)).encode())
                at = end
            found[i] = digest.hexdigest()
    return found


def map_samples(df: DataFrame, keep: list[str], kernel: Callable[[list[Sample | None]], tuple], schema: str, run: int = 6) -> DataFrame:
    """The columns keep of df, and those that kernel makes of some rows' samples (columns prompt, text)."""
    small_batches(df.sparkSession)
    own = T._parse_datatype_string(schema)
    out = T.StructType([*(df.schema[c] for c in keep), *own])
    arrow = to_arrow_schema(out)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            kept, (prompts, texts) = part.columns[:-2], (c.to_pylist() for c in part.columns[-2:])
            made = kernel([sample(p, t, run) for p, t in zip(prompts, texts)])
            yield pa.RecordBatch.from_arrays([*kept, *(pa.array(c, f.type) for c, f in zip(made, list(arrow)[len(keep) :]))], schema=arrow)

    return df.select(*keep, "prompt", "text").mapInArrow(rows, out)
