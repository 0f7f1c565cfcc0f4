"""Language-model scoring: a Katz backoff trigram model with Good-Turing discounts.

A text's tokens are its lower-cased (A-Z) words and one end. Counts of one to K are discounted by
Good-Turing, and what a context's seen words give up is spread over the others in proportion to the
probability that the next lower order gives them, with a weight that makes the context's probabilities
sum to one exactly. A unigram's own discounts go to one unknown word. A token is evaluated recursively:
its trigram if that was seen, else its two words' weight times its bigram if that was seen, else the last
word's weight times its unigram, else the unknown word. A text's first token has its start as its only
context.

Tokens aren't shuffled one by one. Tasks gather documents in chunks of at most CHUNK tokens, written to
the shared folder with their tokens as numbers. For each order in turn, a chunk asks for its different
n-grams once: their keys (64-bit hashes) go in blocks to the table partition that owns their range, which
sums the counts of all chunks, counts the counts and answers in the order asked. Two more exchanges give
the contexts' weights: each n-gram is accounted for by one of the chunks that hold it, only contexts that
held-out text or high counts can need are accounted for, and chunks ask for those they need. Partitions
are cut so that each holds about PART keys asked for; a hot n-gram is asked for once a chunk, not once a
token. A block is a row: there are (chunks x partitions) of them as long as blocks are full, and never
more than different n-grams of each chunk, so rows grow in proportion to the text at most. Answers are
stored beside their chunk, listed in a table, and an exchange's shuffle files are let go once they are:
lost executors cost one exchange at most, and the disk holds the files of one. Lists and results are
brought together before they are written, not left as a file a chunk: for every file that Hadoop's local
file system creates, an executor starts two processes (chmod).

Of n different n-grams, n^2 / 2^65 pairs share a hash: none is expected below 6e9, and at 1e13 one n-gram
in four million takes part in one. Such a pair counts as one n-gram, in all orders and in V.

Defined cases: a null or empty text is its end alone; a null id counts as an empty text in the fold;
repeated rows are scored alike; without training tokens every token has probability one. An empty table
gives an empty one. Other columns are not read, so names can't clash.
"""

from __future__ import annotations

import io
import uuid
from collections import defaultdict
from collections.abc import Callable, Iterator
from itertools import count

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from quire.llm.common import filesystem, fold, fresh_dir, settle, slices, table, written

FOLDS, HELD_OUT, ORDER = 7, 2, 3
CHUNK, PART, K = 1_000_000, 1_500_000, 5
END, START = np.uint64(1), np.uint64(2)
#: A task's chunks are numbered from its partition's number times this.
CHUNKS_PER_TASK = 1 << 20
#: Kinds of rows: a chunk's place, counts of order 1, 2 and 3, and weights of contexts of one and two words.
PLACE, COUNTS, WEIGHTS = 0, (1, 2, 3), (4, 5)
ASKED = "part long, chunk long, kind int, at long, keys binary, x binary, y binary"
ANSWERED = "chunk long, kind int, at long, x binary, y binary, z binary, stats array<double>"
LISTED = "chunk long, kind int, path string, size long, stats array<double>"


def planes(numbers: np.ndarray) -> bytes:
    """Numbers with their first bytes together, then their second ones, and so on: short once compressed."""
    return np.ascontiguousarray(numbers.view(np.uint8).reshape(len(numbers), numbers.itemsize).T).tobytes()


def unplanes(data: bytes, kind: str) -> np.ndarray:
    width = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(width, -1).T).view(kind).ravel()


def pack_keys(keys: np.ndarray) -> bytes:
    return planes(np.diff(keys, prepend=np.uint64(0)))


def unpack_keys(data: bytes) -> np.ndarray:
    return np.cumsum(unplanes(data, "u8"), dtype=np.uint64)


def pair_keys(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A 64-bit key of two hashes in order."""
    x = a * np.uint64(0x9E3779B97F4A7C15) + (b ^ (b >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _store(path: str, **arrays: np.ndarray | bytes) -> int:
    """Writes arrays as one compressed file and returns its size before that."""
    fs, at = filesystem(path)
    data = io.BytesIO()
    np.savez(data, **{k: np.frombuffer(x, np.uint8) if isinstance(x, bytes) else x for k, x in arrays.items()})
    with fs.open_output_stream(at, compression=None) as f:
        f.write(pa.compress(data.getvalue(), codec="zstd", asbytes=True))
    return data.getbuffer().nbytes


def _fetch(path: str, size: int) -> dict[str, np.ndarray]:
    fs, at = filesystem(path)
    with fs.open_input_stream(at, compression=None) as f:
        return dict(np.load(io.BytesIO(pa.decompress(f.read(), size, codec="zstd", asbytes=True))))


def sorting(keys: np.ndarray) -> np.ndarray:
    """How keys sort, equal ones in their order. Numbers sort much faster than places by them, so what is
    sorted is each key's first bits with its place as the last ones; the few keys that differ, but not in
    those first bits, are put in order afterwards."""
    n = len(keys)
    if n < 2:
        return np.arange(n)
    bits = np.uint64((n - 1).bit_length())
    shared = np.uint64(64 - int(keys.max() ^ keys.min()).bit_length())
    if shared == 64:
        return np.arange(n)
    mixed = (keys << shared) >> bits << bits
    mixed |= np.arange(n, dtype=np.uint64)
    mixed.sort()
    order = (mixed & np.uint64((1 << int(bits)) - 1)).astype(np.int64)
    ordered = keys[order]
    wrong = np.flatnonzero(ordered[1:] < ordered[:-1])
    if len(wrong):
        prefix = mixed >> bits
        runs = np.unique(prefix[wrong])
        for a, b in zip(np.searchsorted(prefix, runs).tolist(), np.searchsorted(prefix, runs, "right").tolist()):
            order[a:b] = order[a:b][np.argsort(ordered[a:b], kind="stable")]
    return order


def grouped(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(distinct keys in order, a place of each, each key's number, how the keys sort, where each begins)."""
    order = sorting(keys)
    ordered = keys[order]
    new = np.ones(len(keys), bool)
    new[1:] = ordered[1:] != ordered[:-1]
    begins = np.flatnonzero(new)
    numbers = np.empty(len(keys), np.int64)
    numbers[order] = np.cumsum(new) - 1
    return ordered[begins], order[begins], numbers, order, begins


class Chunk:
    """Documents' tokens as numbers of the chunk's own words, which are sorted by hash."""

    def __init__(self, words: np.ndarray, tokens: np.ndarray, starts: np.ndarray, held: np.ndarray, ids: list):
        self.words, self.tokens, self.starts, self.held, self.ids = words, tokens, starts, held, ids

    @classmethod
    def of(cls, docs: list[tuple], numbers: dict[bytes, int], tokens: list[np.ndarray]) -> Chunk:
        import xxhash

        hashes = np.array([xxhash.xxh64_intdigest(w) for w in numbers], np.uint64)
        hashes[hashes <= START] += np.uint64(3)
        words = np.concatenate([[END, START], hashes]).astype(np.uint64)
        order = np.argsort(words, kind="stable")
        rank = np.empty(len(words), np.uint32)
        rank[order] = np.arange(len(words), dtype=np.uint32)
        starts = np.cumsum([0, *(len(t) for t in tokens)])
        return cls(words[order], rank[np.concatenate(tokens)], starts, np.array([h for _, h in docs]), [i for i, _ in docs])

    def save(self, path: str) -> int:
        ids = pa.array(self.ids, pa.int64())
        known = ids.is_valid().to_numpy(zero_copy_only=False)
        return _store(path, words=pack_keys(self.words), tokens=planes(self.tokens), starts=self.starts, held=self.held, ids=ids.fill_null(0).to_numpy(), known=known)

    @classmethod
    def load(cls, path: str, size: int) -> Chunk:
        data = _fetch(path, size)
        ids = [i if known else None for i, known in zip(data["ids"].tolist(), data["known"].tolist())]
        return cls(unpack_keys(data["words"].tobytes()), unplanes(data["tokens"].tobytes(), "u4"), data["starts"], data["held"], ids)

    def index(self, order: int = ORDER, counts: bool = True, places: bool = True) -> None:
        """The chunk's different n-grams up to an order: keys (sorted), training counts, whether held-out
        text has them; their first part (the context) and last word; each token's n-gram. Without counts, those
        of single words only; without places, keys and counts of the highest order only."""
        n, start = len(self.tokens), int(np.searchsorted(self.words, START))
        firsts = self.starts[:-1]
        held = np.repeat(self.held, np.diff(self.starts))
        self.keys, self.counts, self.asked = {1: self.words}, {}, {}
        self.first, self.last, self.of = {}, {}, {1: self.tokens}
        self.counts[1] = np.bincount(self.tokens[~held], minlength=len(self.words)).astype(np.uint32)
        self.counts[1][start] = int((~self.held).sum())
        self.asked[1] = np.bincount(self.tokens[held], minlength=len(self.words)) > 0
        self.asked[1][start] = True
        self.inner = np.ones(n, bool)  # tokens with two words before them, of which one may be the start
        self.inner[firsts] = False
        if order == 1:
            return
        trained_at = ~held
        hashes = self.words[self.tokens]
        before = np.empty(n, np.int64)
        before[1:] = self.tokens[:-1]
        before[firsts] = start
        keys = pair_keys(self.words[before], hashes)
        for k in range(2, order + 1):
            if k == 3:
                where = np.flatnonzero(self.inner)
                keys, trained_at = pair_keys(keys[where - 1], hashes[where]), trained_at[where]
            if k < order and not places:
                continue
            self.keys[k], at, numbers, sort, begins = grouped(keys)
            if counts:
                trained = np.add.reduceat(trained_at[sort], begins, dtype=np.uint32) if len(begins) else np.zeros(0, np.uint32)
                self.counts[k] = trained
                self.asked[k] = np.diff(begins, append=len(keys)) > trained
            if not places:
                continue
            if k == 3:
                at = where[at]
                before = np.concatenate([[0], self.of[2][:-1]])
            self.first[k], self.last[k] = before[at], self.tokens[at]
            self.of[k] = numbers
            if k == 3:
                self.of[k] = np.full(n, -1, np.int64)
                self.of[k][where] = numbers
                self.tail = self.of[2][at]  # the bigram of a trigram's last two words


def word_codes(texts: pa.Array) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """(different words of a slice, each word's place among them, where each text's words begin and end)."""
    cut = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts.cast(pa.large_string()), "")))
    flat = cut.flatten()
    some = pc.greater(pc.binary_length(flat), 0)  # white space at a text's ends leaves empty words
    coded = flat.filter(some).dictionary_encode()
    before = np.concatenate([[0], np.cumsum(some.to_numpy(zero_copy_only=False))])
    words = coded.dictionary.cast(pa.large_binary()).to_numpy(zero_copy_only=False).tolist()
    return words, coded.indices.to_numpy(), before[cut.offsets.to_numpy()]


def make_chunks(df: DataFrame, id_col: str, text_col: str, chunk: int = CHUNK) -> DataFrame:
    """(chunk, path, size, tokens, words): the chunks, written to the shared folder."""
    out = fresh_dir(df.sparkSession, "chunks")
    fs, root = filesystem(out)
    fs.create_dir(root, recursive=True)
    schema = "chunk long, path string, size long, tokens long, words long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # 0 is the end; 1 the start, which no text has
        fresh = lambda: ([], defaultdict(count(2).__next__), [], 0)
        docs, numbers, tokens, total = fresh()
        task = TaskContext.get().partitionId()
        serial = task * CHUNKS_PER_TASK

        def flush() -> pa.RecordBatch:
            made = Chunk.of(docs, numbers, tokens)
            path = f"{out}/{task:05d}-{uuid.uuid4().hex}"
            return _batch([(serial, path, made.save(path), total, len(made.words))], schema)

        for part in slices(batches):
            words, codes, edges = word_codes(part.column(1))
            ids, at = part.column(0).to_pylist(), 0
            while at < len(ids):
                # as many texts as the chunk takes: the one that fills it is its last
                full = int(np.searchsorted(edges[at + 1 :] - edges[at] + np.arange(1, len(ids) - at + 1), chunk - total))
                to = min(at + full + 1, len(ids))
                own = codes[edges[at] : edges[to]]
                used = np.flatnonzero(np.bincount(own, minlength=len(words)))
                table = np.zeros(len(words), np.uint32)
                table[used] = np.fromiter(map(numbers.__getitem__, map(words.__getitem__, used.tolist())), np.uint32, len(used))
                # each text's words and its end
                found = np.insert(table[own], edges[at + 1 : to + 1] - edges[at], 0)
                docs += [(i, fold(i, FOLDS) == HELD_OUT) for i in ids[at:to]]
                tokens += np.split(found, np.cumsum(np.diff(edges[at : to + 1]) + 1)[:-1])
                total, at = total + len(found), to
                if total >= chunk:
                    yield flush()
                    docs, numbers, tokens, total = fresh()
                    serial += 1
        if docs:
            yield flush()

    return listed(df.select(F.col(id_col).cast("long"), text_col).mapInArrow(run, schema), "chunk-list")


def listed(rows: DataFrame, name: str) -> DataFrame:
    """A list's few rows as a table of few files. They are placed by their chunk's number, which a task that
    runs again finds again; paths are new."""
    return written(rows.repartition("chunk"), name)


ARROW = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "binary": pa.binary(), "array<double>": pa.list_(pa.float64())}


def _batch(rows: list, schema: str) -> pa.RecordBatch:
    arrow = pa.schema([(name, ARROW[kind]) for name, kind in map(str.split, schema.split(", "))])
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(list(zip(*rows)) or [()] * len(arrow), arrow)], schema=arrow)


def _blocks(keys: np.ndarray, bits: int) -> list[tuple[int, int, int]]:
    """(partition, from, to) of sorted keys by their first bits, without empty ones."""
    if not len(keys):
        return []
    parts = (keys >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(keys), np.int64)
    edges = np.flatnonzero(np.diff(parts)) + 1
    return list(zip(parts[np.concatenate([[0], edges])].tolist(), [0, *edges.tolist()], [*edges.tolist(), len(keys)]))


def ask_counts(chunks: DataFrame, order: int, bits: int) -> DataFrame:
    """Blocks of a chunk's n-grams: x their training counts, y whether held-out text has them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk, path, size in zip(*(c.to_pylist() for c in batch.columns)):
                c = Chunk.load(path, size)
                c.index(order, places=False)
                keys, counts, asked = c.keys[order], c.counts[order], c.asked[order]
                rows = [(p, chunk, order, a, pack_keys(keys[a:b]), planes(counts[a:b]), np.packbits(asked[a:b]).tobytes()) for p, a, b in _blocks(keys, bits)]
                yield _batch(rows, ASKED)

    return chunks.select("chunk", "path", "size").mapInArrow(run, ASKED)


def _joined(part: pd.DataFrame) -> tuple[pd.DataFrame, list[np.ndarray], np.ndarray, np.ndarray, np.ndarray]:
    part = part.sort_values(["chunk", "at"], kind="stable")
    keys = [unpack_keys(x) for x in part["keys"]]
    return part, keys, *grouped(np.concatenate(keys))[:3]


def _cut(values: np.ndarray, keys: list[np.ndarray]) -> list[np.ndarray]:
    return np.split(values, np.cumsum([len(k) for k in keys])[:-1])


def _bits(blocks, keys: list[np.ndarray]) -> np.ndarray:
    return np.concatenate([np.unpackbits(np.frombuffer(y, np.uint8), count=len(k)) for y, k in zip(blocks, keys)]).astype(bool)


def sum_counts(part: pd.DataFrame) -> pd.DataFrame:
    """One table partition: x counts summed over chunks; y the first chunk to hold a key as its owner;
    z keys that held-out text has anywhere, or bigrams that are counted too often for a discount.

    stats: keys seen in training, their counts' sum, how many were counted 1, 2, ... K + 1 times.
    """
    part, keys, own, first, back = _joined(part)
    totals = np.bincount(back, np.concatenate([unplanes(x, "u4") for x in part["x"]]), len(own))
    tokens = totals[own != START] if part["kind"].iat[0] == 1 else totals
    seen = tokens[tokens > 0]
    stats = [float(len(seen)), float(seen.sum()), *(float((seen == r).sum()) for r in range(1, K + 2))]
    owner = np.zeros(len(back), bool)
    owner[first] = True
    wanted = np.bincount(back, _bits(part["y"], keys), len(own)) > 0
    if part["kind"].iat[0] == 2:
        wanted |= totals > K
    packed = lambda flags: [np.packbits(x).tobytes() for x in _cut(flags, keys)]
    return pd.DataFrame(
        {
            "chunk": part["chunk"],
            "kind": part["kind"],
            "at": part["at"],
            "x": [planes(x) for x in _cut(totals[back].astype(np.uint64), keys)],
            "y": packed(owner),
            "z": packed(wanted[back]),
            "stats": [stats, *([None] * (len(part) - 1))],
        }
    )


def discounts(stats: list[float]) -> np.ndarray:
    """d[r] for counts r of 0 to K + 1: Katz's Good-Turing ratios, or absolute ones where counts of
    counts can't give ratios between 0 and 1. d[K + 1] is 1 and stands for all higher counts."""
    n = np.array([0.0, *stats[2:]])
    r = np.arange(K + 2.0)
    d = np.ones(K + 2)
    with np.errstate(divide="ignore", invalid="ignore"):
        common = (K + 1) * n[K + 1] / n[1]
        ratio = (r[1 : K + 1] + 1) * n[2:] / n[1 : K + 1] / r[1 : K + 1]
        d[1 : K + 1] = (ratio - common) / (1 - common)
    if not (np.isfinite(d).all() and (d[1 : K + 1] > 0).all() and (d[1 : K + 1] < 1).all()):
        less = n[1] / (n[1] + 2 * n[2]) if n[1] and n[2] else 0.5
        d[1 : K + 1] = 1 - less / r[1 : K + 1]
    return d


class Model:
    """What all tasks need of the corpus: sums and discounts."""

    def __init__(self, stats: dict[int, list[float]]):
        words = stats[1]
        self.types, self.tokens = words[0], words[1]
        self.d = {k: discounts(stats[k]) for k in COUNTS}
        given = sum(words[1 + r] * r * (1 - self.d[1][r]) for r in range(1, K + 1))
        self.unknown = given / self.tokens if self.tokens else 1.0
        self.kept = 1.0
        if self.tokens and self.unknown <= 0:  # no count of K or less: one more token is taken as unknown
            self.unknown, self.kept = 1 / (self.tokens + 1), self.tokens / (self.tokens + 1)

    def unigram(self, counts: np.ndarray) -> np.ndarray:
        return np.where(counts > 0, self.kept * self.discounted(1, counts) / max(self.tokens, 1.0), self.unknown)

    def discounted(self, order: int, counts: np.ndarray) -> np.ndarray:
        return self.d[order][np.minimum(counts, K + 1).astype(np.int64)] * counts.astype(float)


class Answered(Chunk):
    """A chunk with its n-grams' counts in the corpus, and what its contexts have given up."""

    @classmethod
    def of(cls, places: list[dict], order: int = ORDER) -> Answered:
        """The chunk, its n-grams up to an order, and the answers that are stored in the given places."""
        at = {p["kind"]: (p["path"], p["size"]) for p in places}
        c = cls.load(*at[PLACE])
        c.index(order, counts=False)
        c.c, c.owned, c.wanted, c.sums = {}, {}, {}, {}
        for k in COUNTS[:order]:
            n = len(c.keys[k])
            # texts that are all empty have no trigrams
            data = _fetch(*at[k]) if k in at else {name: np.zeros(0, np.uint8) for name in "xyz"}
            c.c[k] = unplanes(data["x"].tobytes(), "u8")
            c.owned[k], c.wanted[k] = (np.unpackbits(data[name], count=n).astype(bool) for name in ("y", "z"))
        for k, kind in zip((1, 2), WEIGHTS):
            if kind in at:
                data = _fetch(*at[kind])
                c.sums[k] = [unplanes(data[name].tobytes(), "f8") for name in ("x", "y")]
        return c

    def needs(self, k: int) -> np.ndarray:
        """The contexts of k words whose weights this chunk's tokens may need. All that training text has
        is seen, so only words of held-out text, and the start; and pairs before an unseen word or a count
        too high for a discount."""
        if k == 1:
            return self.asked[1] & (self.c[1] > 0)
        two = np.zeros(len(self.keys[2]), bool)
        two[self.first[3][(self.c[3] == 0) | (self.c[3] > K)]] = True
        return two & (self.c[2] > 0)

    def given(self, model: Model, k: int) -> tuple[np.ndarray, np.ndarray]:
        """What the chunk's own n-grams add to the sums of their contexts of k words: discounted counts, and
        the discounted counts of the next lower order. Many of these sums are equal, so they are short once
        compressed."""
        mine = self.owned[k + 1] & (self.c[k + 1] > 0) & self.wanted[k][self.first[k + 1]]
        first, n = self.first[k + 1][mine], len(self.keys[k])
        lower = self.c[1][self.last[2][mine]] if k == 1 else self.c[2][self.tail[mine]]
        return np.bincount(first, model.discounted(k + 1, self.c[k + 1][mine]), n), np.bincount(first, model.discounted(k, lower), n)

    def logs(self, model: Model) -> np.ndarray:
        """Each token's log10 probability."""
        kept, weight = {}, {}
        lower = model.kept / max(model.tokens, 1.0)  # what makes the lower order's discounted counts probabilities
        for k in (1, 2):
            context, needed = self.c[k].astype(float), self.needs(k)
            held, seen = np.zeros(len(context)), np.zeros(len(context))
            if needed.any():
                held[needed], seen[needed] = self.sums[k]
            if k == 2:
                lower = kept[1][self.last[2]] / np.maximum(self.c[1][self.last[2]], 1)
            with np.errstate(divide="ignore", invalid="ignore"):
                left = np.where(needed, 1 - held / context, 1.0)
                # a context all of whose counts are too high for a discount: one more count is taken as given up
                full = left <= 1e-9
                kept[k] = np.where(full, context / (context + 1), 1.0)
                weight[k] = np.where(full, 1 / (context + 1), left) / (1 - lower * seen)
        c1, c2, c3 = (self.c[k].astype(float) for k in COUNTS)
        with np.errstate(divide="ignore", invalid="ignore"):
            f2, f3 = self.first[2], self.first[3]
            p2 = np.where(c2 > 0, kept[1][f2] * model.discounted(2, self.c[2]) / c1[f2], weight[1][f2] * model.unigram(self.c[1])[self.last[2]])
            p3 = np.where(c3 > 0, kept[2][f3] * model.discounted(3, self.c[3]) / c2[f3], weight[2][f3] * p2[self.tail])
        out = np.empty(len(self.tokens))
        out[self.inner] = np.log10(p3)[self.of[3][self.inner]]
        out[~self.inner] = np.log10(p2)[self.of[2][~self.inner]]
        return out


def ask_weights(chunk: int, places: list[dict], model: Model, k: int, bits: int) -> pa.RecordBatch:
    """A chunk's part of the sums of its contexts of k words (x, two numbers a key), and which of them it
    needs (y)."""
    c = Answered.of(places, k + 1)
    need, (held, seen) = c.needs(k), c.given(model, k)
    some = np.flatnonzero((held > 0) | need)
    keys, held, seen, need = c.keys[k][some], held[some], seen[some], need[some]
    rows = [(p, chunk, WEIGHTS[k - 1], a, pack_keys(keys[a:b]), planes(held[a:b]) + planes(seen[a:b]), np.packbits(need[a:b]).tobytes()) for p, a, b in _blocks(keys, bits)]
    return _batch(rows, ASKED)


def sum_weights(part: pd.DataFrame) -> pd.DataFrame:
    """Both sums of every context (x and y), for the keys that chunks need."""
    part, keys, own, _, back = _joined(part)
    halves = lambda i: np.concatenate([unplanes(x[len(x) // 2 * i : len(x) // 2 * (i + 1)], "f8") for x in part["x"]])
    sums = [np.bincount(back, halves(i), len(own))[back] for i in (0, 1)]
    need = _cut(_bits(part["y"], keys), keys)
    x, y = ([planes(v[n]) for v, n in zip(_cut(s, keys), need)] for s in sums)
    return pd.DataFrame({"chunk": part["chunk"], "kind": part["kind"], "at": part["at"], "x": x, "y": y, "z": None, "stats": None})


def score_chunk(places: list[dict], model: Model, arrow: pa.Schema) -> pa.RecordBatch:
    c = Answered.of(places)
    base = np.log10((c.c[1] + np.uint64(1)).astype(float) / (model.tokens + model.types + 1))[c.tokens]
    total = lambda x: np.add.reduceat(x, c.starts[:-1])
    known, n = total((c.c[1][c.tokens] > 0).astype(np.int64)), len(c.ids)
    columns = (c.ids, c.held, np.diff(c.starts), known, np.full(n, int(model.tokens)), total(base), total(c.logs(model)))
    return pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(columns, arrow)], schema=arrow)


def stored(answers: DataFrame, least: int, tasks: int, serials: int, name: str) -> DataFrame:
    """Each chunk's answers of each kind in a file: (chunk, kind, path, size, stats of the rows it got).

    Chunks are dealt to tasks by their number, not by a hash, so that no task gets several while others
    get none; serials is the most chunks that one task made, least how many must have answers.
    """
    out = fresh_dir(answers.sparkSession, name)
    fs, root = filesystem(out)
    fs.create_dir(root, recursive=True)
    names = answers.columns

    def keep(held: list[tuple]) -> pa.RecordBatch:
        rows, done = pd.DataFrame(held, columns=names), []
        for kind, part in rows.groupby("kind"):
            part = part.sort_values("at")
            path = f"{out}/{int(part['chunk'].iat[0])}-{kind}-{uuid.uuid4().hex}"
            number = "f8" if kind in WEIGHTS else "u8"
            x = [unplanes(v, number) for v in part["x"]]
            if kind in WEIGHTS:
                rest = {"y": planes(np.concatenate([unplanes(v, number) for v in part["y"]]))}
            else:
                rest = {c: np.packbits(_bits(part[c], x)) for c in ("y", "z")}
            stats = [v for v in part["stats"] if v is not None]
            size = _store(path, x=planes(np.concatenate(x)), **rest)
            done.append((int(part["chunk"].iat[0]), int(kind), path, size, np.sum(stats, axis=0).tolist() if stats else None))
        return _batch(done, LISTED)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if held and row[0] != held[0][0]:
                    yield keep(held)
                    held = []
                held.append(row)
        if held:
            yield keep(held)

    number = F.shiftright("chunk", 20) * serials + F.pmod("chunk", F.lit(CHUNKS_PER_TASK))
    d = answers.withColumn("p", F.pmod(number, F.lit(tasks)).cast("int")).repartitionById(tasks, F.col("p")).drop("p")
    found = listed(d.sortWithinPartitions("chunk").mapInArrow(run, LISTED), f"{name}-list")
    answered = found.select("chunk").distinct().count()
    if answered < least:
        raise ValueError(f"{name}: {answered} of {least} chunks have their answers")
    return found


def over_chunks(places: DataFrame, n: int, kernel: Callable[[int, list[dict]], pa.RecordBatch], schema: str) -> DataFrame:
    """kernel over each chunk's number and the places of its files, a task a chunk."""
    d = places.groupBy("chunk").agg(F.collect_list(F.struct("kind", "path", "size")).alias("places")).repartition(n)  # six places at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk, held in zip(*(c.to_pylist() for c in batch.columns)):
                yield kernel(chunk, held)

    return d.mapInArrow(run, schema)


def score_texts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", chunk: int = CHUNK, part: int = PART) -> DataFrame:
    """Per row: id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    spark = df.sparkSession
    result = f"`{id_col}` long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    chunks = make_chunks(df, id_col, text_col, chunk)
    n, tokens, words, last, most = chunks.agg(F.count("*"), F.sum("tokens"), F.sum("words"), F.max(F.pmod("chunk", F.lit(CHUNKS_PER_TASK))), F.max(F.shiftright("chunk", 20))).first()
    if not n:
        return spark.createDataFrame([], result)
    serials = int(last) + 1
    tasks = max(1, min((int(most) + 1) * serials, 2 * n))
    bits = {k: int((words if k == 1 else tokens) // part).bit_length() for k in COUNTS}
    spread = chunks.repartition(n)
    places = chunks.select("chunk", F.lit(PLACE).alias("kind"), "path", "size")
    names, stats = [F.sum(F.col("stats")[i]).alias(f"s{i}") for i in range(K + 3)], {}
    for k in COUNTS:
        found = stored(ask_counts(spread, k, bits[k]).groupBy("part").applyInPandas(sum_counts, ANSWERED), n if k < 3 else 0, tasks, serials, f"counts-{k}")
        row = found.where("stats IS NOT NULL").agg(*names).first()
        stats[k] = [row[f"s{i}"] or 0.0 for i in range(K + 3)]
        places = places.unionByName(found.drop("stats"))
        settle(spark)
    model = Model(stats)
    for k in (1, 2):
        asked = over_chunks(places, n, lambda chunk, held: ask_weights(chunk, held, model, k, bits[k]), ASKED)  # noqa: B023
        places = places.unionByName(stored(asked.groupBy("part").applyInPandas(sum_weights, ANSWERED), 0, tasks, serials, f"weights-{k}").drop("stats"))
        del asked
        settle(spark)
    arrow = to_arrow_schema(T._parse_datatype_string(result))
    return over_chunks(places, n, lambda _, held: score_chunk(held, model, arrow), result).hint("rebalance")


def query(spark, sf_dir: str) -> DataFrame:
    return score_texts(table(spark, sf_dir, "documents"))
