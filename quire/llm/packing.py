"""Sequence packing by Karmarkar-Karp multiway differencing.

A document's tokens (ids by the tokenizers library, then one end id) are cut into full windows and a
rest. Of every GROUP documents in a row of a task, the rests are cut into pieces of at most PIECE tokens
and divided among the fewest windows that can hold them: the two partial partitions of the widest
imbalance are merged with opposing imbalances until one is left. If its fullest window exceeds the
capacity, the number of windows rises and the rests are divided anew.

Groups follow the rows of an input partition, so nothing is shuffled, no key can be hot, and a task
holds the rests of GROUP documents at most. Sequence ids are unique over all tasks.

Defined cases: a null or empty text is the end id alone; repeated rows and null ids are packed like any
other row; an empty table gives an empty one; other columns are not read, so names can't clash.
"""

from __future__ import annotations

import heapq
import os
import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from quire.llm.common import SLICE_BYTES, slices, table

CAPACITY, GROUP, PIECE = 1024, 256, 256
#: Bytes of ids and texts that a worker keeps for parts of texts seen before; longer parts aren't kept.
CACHE_BYTES, LONGEST_KEPT = 128 << 20, 64
#: Bytes a part kept, while a slice is looked up: an entry of Arrow's hash table, and its copy of the text.
LOOKED_UP = 100
#: New words that are encoded as one text; code points that are given to the tokenizer at once.
WORDS_JOINED, ENCODED = 256, 1 << 16
#: Letters for Python's and the tokenizer's Unicode alike; words of these alone are one piece of the pattern.
LETTERS = re.compile("[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f\u0391-\u03a1\u03a3-\u03c9\u0400-\u0481\u05d0-\u05ea\u3041-\u3096\u30a1-\u30fa\u4e00-\u9fa5\uac00-\ud7a3]+").fullmatch


def kk_partition(sizes: list[int], k: int) -> list[list[int]]:
    """Indexes of sizes in k windows of near-equal sums, by multiway differencing.

    A partial partition is its windows above the emptiest, fullest first, as (excess, indexes) pairs,
    with the indexes of the windows level with the emptiest one after them.
    """
    if k <= 1:
        return [list(range(len(sizes)))]
    heap = [(-s, i, [(s, [i])], []) for i, s in enumerate(sizes)]
    heapq.heapify(heap)
    serial = len(sizes)
    while len(heap) > 1:
        a, b = heapq.heappop(heap), heapq.heappop(heap)
        serial += 1
        above, level = _opposed(a[2], a[3], b[2], b[3], k)
        heapq.heappush(heap, (-(above[0][0] if above else 0), serial, above, level))
    _, _, above, level = heap[0] if heap else (0, 0, [], [])
    windows = [x for _, x in above] + level
    return windows + [[] for _ in range(k - len(windows))]


def _opposed(a: list, a_level: list, b: list, b_level: list, k: int) -> tuple[list, list]:
    if len(a) + len(b) <= k and not a_level and not b_level:  # no window above meets another
        return sorted(a + b, key=lambda x: -x[0]), []
    full_a = a + [(0, x) for x in a_level] + [(0, [])] * (k - len(a) - len(a_level))
    full_b = b + [(0, x) for x in b_level] + [(0, [])] * (k - len(b) - len(b_level))
    return _level([(x + y, p + q) for (x, p), (y, q) in zip(full_a, reversed(full_b))])


def _level(windows: list) -> tuple[list, list]:
    windows.sort(key=lambda x: -x[0])
    least = windows[-1][0]
    return [(s - least, p) for s, p in windows if s > least], [p for s, p in windows if s == least and p]


def divide(sizes: list[int], capacity: int = CAPACITY) -> list[list[int]]:
    """sizes in as few near-equal windows as the differencing keeps within capacity."""
    if not sizes:
        return []
    k = max(1, -(-sum(sizes) // capacity))
    while True:
        windows = kk_partition(sizes, k)
        if max(sum(sizes[i] for i in w) for w in windows) <= capacity:
            return [w for w in windows if w]
        k += 1


class Tokens:
    """Packed ids by the tokenizers library; what was encoded before is looked up."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.signs = _signs()
        line, vocabulary = chr(self.signs[0x0A]), self.tokenizer.get_vocab()
        self.line = vocabulary[line]
        # no token has a line feed and other signs than white space's: then none joins it to a word before it
        alone = not any(line in t and t.strip(line + chr(self.signs[0x20])) for t in vocabulary)
        self.words = Tokenizer(self.tokenizer.model)
        self.words.pre_tokenizer = pre_tokenizers.Split(line, "merged_with_previous" if alone else "isolated")
        self._forget()

    def _forget(self) -> None:
        self.seen, self.ids = pa.array([""], pa.large_string()), pa.array([b""], pa.large_binary())

    @property
    def parts(self) -> list[str]:
        """The parts whose ids are kept."""
        return self.seen.to_pylist()

    def held(self) -> int:
        """Bytes of what is kept, twice as a slice's new parts are added, and of the table by which it is looked up."""
        return 2 * (self.seen.nbytes + self.ids.nbytes) + LOOKED_UP * len(self.seen)

    def encode(self, texts: list[str]) -> list[bytes]:
        """Arrow finds a slice's different parts, looks them up and joins their ids; Python sees new parts only."""
        from quire.llm.bpe import mark_cuts

        marked = [mark_cuts(t) for t in texts]
        cut = pc.split_pattern(pa.array([m for m in marked if m is not None], pa.large_string()), "\0")
        coded, offsets = cut.flatten().dictionary_encode(), cut.offsets.to_numpy()
        del cut
        if self.held() > CACHE_BYTES:
            self._forget()
        place = pc.index_in(coded.dictionary, value_set=self.seen)
        new = coded.dictionary.filter(place.is_null())
        found = pa.array(self._new(new.to_pylist()), pa.large_binary())
        ids = pa.concat_arrays([self.ids, found])
        place = place.to_numpy(zero_copy_only=False)
        place = np.where(np.isnan(place), len(self.ids) - 1 + np.isnan(place).cumsum(), place).astype(np.int64)
        short = pc.less_equal(pc.utf8_length(new), LONGEST_KEPT)
        self.seen, self.ids = pa.concat_arrays([self.seen, new.filter(short)]), pa.concat_arrays([self.ids, found.filter(short)])
        joined = ids.take(pa.array(place).take(coded.indices))
        ends = np.frombuffer(joined.buffers()[1], np.int64)[offsets].tolist() if len(joined) else [0]
        data, at = joined.buffers()[2], zip(ends, ends[1:])
        odd = self._whole([t for t, m in zip(texts, marked) if m is None])
        return [next(odd) if m is None else _between(data, *next(at)) for m in marked]

    def _new(self, parts: list[str]) -> list[bytes]:
        plain = [bool(LETTERS(p, p[:1] == " ")) for p in parts]
        words = self._words([p for p, w in zip(parts, plain) if w])
        rest = self._whole([p for p, w in zip(parts, plain) if not w])
        return [next(words if w else rest) for w in plain]

    def _whole(self, texts: list[str]) -> Iterator[bytes]:
        for some in _batches(texts):
            yield from (_packed(e.ids) for e in self.tokenizer.encode_batch_fast(some, add_special_tokens=False))

    def _words(self, words: list[str]) -> Iterator[bytes]:
        """Words of LETTERS, each one piece of the pattern wherever it stands, so the model alone gives their
        ids: many are encoded as the lines of one text, whose ids are cut at those of the line feeds."""
        texts = ["\n".join(words[i : i + WORDS_JOINED]).encode() for i in range(0, len(words), WORDS_JOINED)]
        shown = [self.signs[np.frombuffer(t, np.uint8)].tobytes().decode("utf-32-le") for t in texts]
        for some in _batches(shown):
            for e in self.words.encode_batch_fast(some, add_special_tokens=False):
                ids = np.array(e.ids, np.uint32)
                data, ends = ids.tobytes(), 4 * np.flatnonzero(ids == self.line)
                yield from (data[a:b] for a, b in zip([0, *(ends + 4).tolist()], [*ends.tolist(), len(data)]))


def _batches(texts: list[str]) -> Iterator[list[str]]:
    """Texts in a row of about ENCODED code points together: what the tokenizer returns takes many times the ids' bytes."""
    some, size = [], 0
    for t in texts:
        some.append(t)
        size += len(t)
        if size >= ENCODED:
            yield some
            some, size = [], 0
    if some:
        yield some


def _signs() -> np.ndarray:
    """The character that stands for each byte in a byte-level vocabulary."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = iter(range(0x100, 0x200))
    return np.array([b if b in plain else next(others) for b in range(256)], "<u4")


def _between(data: pa.Buffer | None, a: int, b: int) -> bytes:
    return data.slice(a, b - a).to_pybytes() if a < b else b""


def _packed(ids: list[int]) -> bytes:
    return array("I", ids).tobytes()


_tokens: dict[str, Tokens] = {}


def tokens(path: str) -> Tokens:
    if path not in _tokens:
        _tokens[path] = Tokens(path)
    return _tokens[path]


class Packer:
    """Rows of a task in, pieces out: (document, start, ids, document's tokens, sequence, offset)."""

    def __init__(self, task: int, capacity: int = CAPACITY, group: int = GROUP, piece: int = PIECE):
        self.next, self.capacity, self.group, self.piece = task << 40, capacity, group, piece
        self.rests: list[tuple] = []

    def add(self, doc_id, packed: bytes) -> Iterator[tuple]:
        n = len(packed) // 4
        full = n - n % self.capacity
        for at in range(0, full, self.capacity):
            yield doc_id, at, packed[4 * at : 4 * (at + self.capacity)], n, self.next, 0
            self.next += 1
        if full < n:
            self.rests.append((doc_id, full, packed[4 * full :], n))
        if len(self.rests) >= self.group:
            yield from self.flush()

    def flush(self) -> Iterator[tuple]:
        pieces = [(d, at + i, p[4 * i : 4 * (i + self.piece)], n) for d, at, p, n in self.rests for i in range(0, len(p) // 4, self.piece)]
        self.rests = []
        for window in divide([len(p[2]) // 4 for p in pieces], self.capacity):
            offset = 0
            for i in sorted(window):
                d, at, p, n = pieces[i]
                yield d, at, p, n, self.next, offset
                offset += len(p) // 4
            self.next += 1


def gathered(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Short slices in a row as one of about SLICE_BYTES at most: the more texts at once, the fewer look-ups."""
    held, size = [], 0
    for part in parts:
        if held and size + part.nbytes > SLICE_BYTES:
            yield pa.concat_batches(held)
            held, size = [], 0
        held.append(part)
        size += part.nbytes
    if held:
        yield pa.concat_batches(held)


def pack(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = 0, capacity: int = CAPACITY, with_ids: bool = True) -> DataFrame:
    """Per piece: id, start, length, ids_crc32, doc_tokens, sequence_id, offset and, unless with_ids is
    off, ids (packed little-endian unsigned 32-bit integers)."""
    kind = df.select(id_col).dtypes[0][1]
    schema = T._parse_datatype_string(
        f"`{id_col}` {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long" + ", ids binary" * with_ids
    )
    arrow, end = to_arrow_schema(schema), end_id.to_bytes(4, "little")

    def rows(pieces: Iterator[tuple]) -> pa.RecordBatch:
        out = [(d, at, len(p) // 4, zlib.crc32(p), n, s, o, *([p] if with_ids else [])) for d, at, p, n, s, o in pieces]
        columns = list(zip(*out)) or [()] * len(arrow)
        return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(columns, arrow)], schema=arrow)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, packer = tokens(path), Packer(TaskContext.get().partitionId(), capacity)
        for part in gathered(slices(batches)):
            packed = encoder.encode([t or "" for t in part.column(1).to_pylist()])
            pa.default_memory_pool().release_unused()  # workers stay, and their memory adds to the executor's
            yield rows(x for d, p in zip(part.column(0).to_pylist(), packed) for x in packer.add(d, p + end))
        yield rows(packer.flush())

    return df.select(id_col, text_col).mapInArrow(run, schema)


def query(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), with_ids=False)
