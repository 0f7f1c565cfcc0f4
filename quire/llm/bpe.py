"""Byte-level BPE by a lazily determinised finite-state transducer; streaming decode.

A token sequence is a piece's BPE encoding exactly if each two neighbours are what the merges leave
side by side, so encoding is a finite-state relation: a configuration is the last token, the trie node
of the bytes read since, and the tokens that not all configurations agree on. The subset construction
runs lazily: a state is a set of configurations, a move's output is the tokens that all of them have come
to share, and these are emitted at once, before the piece ends. A configuration lasts no longer than the
longest token, so tokens wait for few bytes. States and cached words are dropped when there are too many,
so memory stays bounded for any text.

Decoding streams too: an automaton over bytes knows where characters end, and what is left of one after
a token is kept for the next. Bytes that are no UTF-8 become U+FFFD, one for each longest beginning of a
character.

Defined cases: a null text is an empty one (no tokens); each row, repeated or with a null id, gives
its own row; an empty table gives an empty one; other columns are not read, so names can't clash.
"""

from __future__ import annotations

import base64
import os
import re
from collections.abc import Iterable, Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.common import map_rows, table

MAX_STATES, MAX_WORDS = 250_000, 500_000
#: A stop or comma before a space or line feed that follows another sign.
SIGNS = re.compile(r"[.,](?<=[\W_].)[ \n]")
#: White space beside a space or line feed, white space of other kinds, the mark that mark_cuts uses.
ODD_ASCII = ("  ", " \n", "\n ", "\n\n", "\0", *"\t\r\x0b\x0c\x1c\x1d\x1e\x1f")
ODD_WIDE = tuple("\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000")


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


class Transducer:
    """Compiled merges. encode() takes one piece of the pre-splitting pattern and returns packed ids;
    a Stream takes a piece's bytes as they come and returns ids as soon as they are sure."""

    def __init__(self, ranks: dict[bytes, int], max_states: int = MAX_STATES):
        self.ranks, self.max_states = ranks, max_states
        self.bytes_of = {i: b for b, i in ranks.items()}
        self.longest_whole = 0
        self.packed = {i: int(i).to_bytes(4, "little") for i in ranks.values()}
        self.split: dict[int, tuple[int, int]] = {}
        self.pair: dict[tuple[int, int], int] = {}
        self.node: dict[int, int] = {}
        self.token_at: list[int] = [-1]
        self.below: list[list[int]] = [[]]
        for token, rank in sorted(ranks.items(), key=lambda x: x[1]):
            if len(token) == 1:
                self.split[rank] = (rank, rank)
            else:
                parts = self._merged(token, rank)
                if len(parts) != 2:
                    self.longest_whole = max(self.longest_whole, len(token))
                    continue  # never what merging leaves, except for a whole piece
                self.split[rank] = parts
                self.pair[parts] = rank
            at = 0
            for b in token:
                key = at << 8 | b
                nxt = self.node.get(key)
                if nxt is None:
                    nxt = self.node[key] = len(self.token_at)
                    self.token_at.append(-1)
                    self.below.append([])
                    self.below[at].append(nxt)
                at = nxt
            self.token_at[at] = rank
        self.fits: dict[tuple[int, int], bool] = {}
        self._reset()

    def _merged(self, token: bytes, below: int) -> tuple[int, ...]:
        """The ids that merges of a rank under below leave of token."""
        parts = [token[i : i + 1] for i in range(len(token))]
        while len(parts) > 1:
            best, at = min((self.ranks.get(parts[i] + parts[i + 1], below), i) for i in range(len(parts) - 1))
            if best >= below:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return tuple(self.ranks[p] for p in parts)

    def _side_by_side(self, a: int, b: int) -> bool:
        """Whether merging leaves token a before token b: no merge across them ever comes first."""
        found = self.fits.get((a, b))
        if found is None:
            found = self.fits[a, b] = self._undisturbed(a, b)
        return found

    def _undisturbed(self, a: int, b: int) -> bool:
        # Undo the later of the two tokens' own merges again and again; a merge across the border that
        # would have come before the one just undone breaks the pair.
        limit = 1 << 60
        while True:
            if self.pair.get((a, b), limit) < limit:
                return False
            if a > b:
                limit = a
                left, right = self.split[a]
                if right == a:
                    limit = b + 1
                    b = self.split[b][0]
                    if b + 1 == limit:
                        return True
                else:
                    a = right
            else:
                limit = b + 1
                left = self.split[b][0]
                if left == b:
                    limit = a
                    a = self.split[a][1]
                    if a == limit:
                        return True
                else:
                    b = left

    def _reset(self) -> None:
        self.states: list[tuple] = [((-1, 0, ()),)]
        self.ids: dict[tuple, int] = {self.states[0]: 0}
        self.rest: list[bytes] = [b""]
        self.moves: dict[int, tuple[int, bytes]] = {}

    def state(self, key: tuple) -> int:
        found = self.ids.get(key)
        if found is None:
            found = self.ids[key] = len(self.states)
            self.states.append(key)
            self.rest.append(b"".join(self.packed[t] for t in next(waiting for _, node, waiting in key if node == 0)))
        return found

    def _step(self, state: int, byte: int) -> tuple[int, bytes]:
        """The state after byte, every configuration's next ones, and the ids that they now share. One of
        the configurations has just ended a token."""
        nxt = []
        for last, node, waiting in self.states[state]:
            child = self.node.get(node << 8 | byte)
            if child is not None:
                token = self.token_at[child]
                if token >= 0 and (last < 0 or self._side_by_side(last, token)):
                    nxt.append((token, 0, (*waiting, token)))
                if self.below[child]:
                    nxt.append((last, child, waiting))
        sure = os.path.commonprefix([waiting for _, _, waiting in nxt])
        key = tuple(sorted((last, node, waiting[len(sure) :]) for last, node, waiting in nxt))
        found = self.moves[state << 8 | byte] = self.state(key), b"".join(map(self.packed.__getitem__, sure))
        return found

    def advance(self, state: int, data: bytes) -> tuple[int, list[bytes]]:
        """The state after data, and the ids that have become sure."""
        moves, out = self.moves, []
        for byte in data:
            move = moves.get(state << 8 | byte)
            if move is None:
                if len(self.states) > 2 * self.max_states:  # within one very long piece
                    key = self.states[state]
                    self._reset()
                    state, moves = self.state(key), self.moves
                move = self._step(state, byte)
            state, sure = move
            if sure:
                out.append(sure)
        return state, out

    def encode(self, piece: bytes) -> bytes:
        """The piece's ids as little-endian unsigned 32-bit integers."""
        whole = self.ranks.get(piece)
        if whole is not None:
            return self.packed[whole]
        if len(self.fits) > 20 * self.max_states:
            self.fits.clear()
        if len(self.states) > self.max_states:
            self._reset()
        state, out = self.advance(0, piece)
        out.append(self.rest[state])
        return b"".join(out)


class Stream:
    """One piece, byte by byte. Ids are held back only while the piece may still be a token that merging
    never leaves, which a piece is as a whole."""

    def __init__(self, transducer: Transducer):
        self.transducer, self.key, self.begun, self.held = transducer, transducer.states[0], b"", b""

    def feed(self, data: bytes) -> bytes:
        t = self.transducer
        state, out = t.advance(t.state(self.key), data)
        self.key = t.states[state]
        self.held += b"".join(out)
        if len(self.begun) <= t.longest_whole:
            self.begun += data[: t.longest_whole + 1]
        if len(self.begun) <= t.longest_whole:
            return b""
        sure, self.held = self.held, b""
        return sure

    def end(self) -> bytes:
        t = self.transducer
        whole = t.ranks.get(self.begun) if len(self.begun) <= t.longest_whole else None
        return self.held + t.rest[t.state(self.key)] if whole is None else t.packed[whole]


def mark_cuts(text: str) -> str | None:
    """The text with a mark (a null sign) where no piece of the pattern crosses, or None where that isn't so simple."""
    for odd in ODD_ASCII if text.isascii() else ODD_ASCII + ODD_WIDE:
        if odd in text:
            return None
    if SIGNS.search(text):
        return None
    text = text.replace(" ", "\0 ").replace("\n", "\0\n\0")
    return text.replace(".\0", "\0.\0").replace(",\0", "\0,\0")


def cut_at_spaces(text: str) -> list[str] | None:
    """The text in parts that no piece of the pattern crosses, or None where cutting isn't that simple."""
    marked = mark_cuts(text)
    return None if marked is None else marked.split("\0")


class Words(dict):
    """Packed ids by part of a text; filled as parts come up, emptied when full."""

    def __init__(self, encode):
        self.encode = encode

    def __missing__(self, part: str) -> bytes:
        if len(self) > MAX_WORDS:
            self.clear()
        found = self.encode(part)
        if len(part) < 64:
            self[part] = found
        return found


class Encoder:
    """Whole texts: the pattern's pieces through the transducer."""

    def __init__(self, path: str, pattern: str):
        import regex

        self.transducer = Transducer(read_ranks(path))
        self.pieces = regex.compile(pattern).findall
        self.words = Words(self._parts)
        self.table = [self.transducer.bytes_of.get(i, b"") for i in range(max(self.transducer.bytes_of) + 1)]
        #: A token's text if it is of whole characters, else None.
        self.texts = [b.decode() if _whole(b) else None for b in self.table]
        self.of_whole = np.array([t is not None for t in self.texts])

    def _parts(self, text: str) -> bytes:
        return b"".join([self.transducer.encode(p.encode()) for p in self.pieces(text)])

    def encode(self, text: str) -> bytes:
        parts = cut_at_spaces(text)
        if parts is None:
            words = self.words
            return b"".join([words[p] for p in self.pieces(text)])
        return b"".join(map(self.words.__getitem__, parts))

    def decode(self, packed: bytes) -> bytes:
        return b"".join(map(self.table.__getitem__, np.frombuffer(packed, "<u4").tolist()))


#: (first bytes, bytes that may follow, state after one of these); state 0 is between characters, and 1 and 2
#: wait for one and for two bytes of any kind.
LEADS = ((0xC2, 0xDF, 0x80, 0xBF, 0), (0xE0, 0xE0, 0xA0, 0xBF, 1), (0xE1, 0xEC, 0x80, 0xBF, 1), (0xED, 0xED, 0x80, 0x9F, 1), (0xEE, 0xEF, 0x80, 0xBF, 1),
         (0xF0, 0xF0, 0x90, 0xBF, 2), (0xF1, 0xF3, 0x80, 0xBF, 2), (0xF4, 0xF4, 0x80, 0x8F, 2))


def _automaton() -> list[list[int]]:
    """The state after each byte in each state; -1 where no character goes on so."""
    moves = [[0] * 128 + [-1] * 128] + [[-1] * 256 for _ in range(2 + len(LEADS))]
    for state in (1, 2):
        moves[state][0x80:0xC0] = [state - 1] * 64
    for state, (low, high, least, most, to) in enumerate(LEADS, 3):
        moves[0][low : high + 1] = [state] * (high + 1 - low)
        moves[state][least : most + 1] = [to] * (most + 1 - least)
    return moves


UTF8 = _automaton()


def _whole(data: bytes) -> bool:
    """Whether data is of whole characters."""
    state = 0
    for byte in data:
        state = UTF8[state][byte]
        if state < 0:
            return False
    return state == 0


class Utf8Machine:
    """Incremental UTF-8: feed() gives the characters that data completes, and keeps an unfinished one."""

    def __init__(self):
        self.state, self.begun = 0, bytearray()

    def feed(self, data: bytes) -> str:
        state, begun, out = self.state, self.begun, []
        for byte in data:
            to = UTF8[state][byte]
            if to < 0 and state:  # the character before breaks off; the byte may begin another
                out.append("\ufffd")
                begun.clear()
                to = UTF8[0][byte]
            if to < 0:
                out.append("\ufffd")
                to = 0
            else:
                begun.append(byte)
                if not to:
                    out.append(begun.decode())
                    begun.clear()
            state = to
        self.state = state
        return "".join(out)

    def end(self) -> str:
        broken, self.state = bool(self.begun), 0
        self.begun.clear()
        return "\ufffd" if broken else ""


def stream_decode(encoder: Encoder, packed: bytes, at_once: int = 4096) -> Iterator[str]:
    """The text of packed ids, at_once ids at a time, never cutting a character."""
    machine, texts, table = Utf8Machine(), encoder.texts, encoder.table
    for i in range(0, len(packed), 4 * at_once):
        ids = np.frombuffer(packed[i : i + 4 * at_once], "<u4")
        if not machine.state and encoder.of_whole[ids].all():
            yield "".join(map(texts.__getitem__, ids.tolist()))
            continue
        out = []
        for k in ids.tolist():
            text = texts[k]
            out.append(text if text is not None and not machine.state else machine.feed(table[k]))
        yield "".join(out)
    yield machine.end()


_encoders: dict[tuple[str, str], Encoder] = {}


def encoder(path: str, pattern: str) -> Encoder:
    """The worker's encoder for this vocabulary; compiled once a worker process."""
    if (path, pattern) not in _encoders:
        _encoders[path, pattern] = Encoder(path, pattern)
    return _encoders[path, pattern]


def encode_texts(df: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, ids (packed little-endian unsigned 32-bit integers), n_tokens, decoded text."""

    def kernel(enc: Encoder, keys: list, texts: Iterable[str | None]) -> tuple:
        ids = [enc.encode(t or "") for t in texts]
        return keys, ids, [len(x) // 4 for x in ids], ["".join(stream_decode(enc, x)) for x in ids]

    kind = df.select(id_col).dtypes[0][1]
    return map_rows(df.select(id_col, text_col), kernel, f"`{id_col}` {kind}, ids binary, n_tokens long, decoded string", lambda: encoder(path, pattern))


def query(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    d = encode_texts(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    return d.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))
