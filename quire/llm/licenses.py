"""License scans by template-markup matching.

A template is a licence's mandatory words with marked regions: `[words]` may be missing, `{n}` stands
for up to n words of any kind, `(a|b)` is one of the choices. Each is compiled to an automaton over
words; a place in a text is accepted if the automaton reads the mandatory wording exactly. There are
whole texts (label ending in -text, score 1), headers and notices, and openings, which say less (0.7).
Beside the templates stand the base phrases, whose every place is counted.

Words are lower-cased (A-Z) runs of ASCII letters and digits and of all other characters outside ASCII.

Defined cases: a null text is an empty one (no words, no labels, score 0); each row, repeated or with a
null id, gives its own row; an empty table gives an empty one; other columns are not read, so names
can't clash. Nothing is shuffled, and a task holds one slice of rows; an automaton's state set is
bounded by its template, whatever the text's length.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm import license_texts
from quire.llm.common import map_rows, table

PHRASES = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))
#: (label, score, markup). Parts of a template are joined by spaces.
TEMPLATES: tuple[tuple[str, float, tuple[str, ...]], ...] = (
    ("mit-notice", 0.9, ("(released|licensed|distributed|available|published) under", "[the terms of] [the] mit license")),
    ("apache-2.0", 0.95, ("licensed under the apache license", "[version] 2 0 [the license]")),
    ("apache-notice", 0.8, ("(released|licensed|distributed|available|published) under", "[the terms of] [the] apache license")),
    ("gpl-notice", 0.9, ("(released|licensed|distributed|available|published) under", "[the terms of] [the] [gnu] [lesser|affero] general public license")),
    ("gpl-2", 0.95, ("gnu general public license", "[as published by the free software foundation either]", "(version|v) 2 [0] [of the license] [or at your option any] [or] [later] [version]")),
    ("gpl-3", 0.95, ("gnu general public license", "[as published by the free software foundation either]", "(version|v) 3 [0] [of the license] [or at your option any] [or] [later] [version]")),
    ("gpl-header", 1.0, ("{4} is free software", "you can redistribute it", "and or modify it", "under the terms of the", "gnu general public license")),
    ("lgpl", 0.95, ("gnu (lesser|library) general public license", "[version 2 1|version 3|version 2]")),
    ("agpl", 0.95, ("gnu affero general public license", "[version 3]")),
    ("cc", 0.95, ("licensed under [a|the] (cc|creative commons)", "(by|attribution)", "[nc|noncommercial|non commercial] [nd|noderivatives|no derivatives]", "[sa|sharealike|share alike]", "[1 0|2 0|2 5|3 0|4 0] [international|unported] [license]")),
    ("cc0", 0.95, ("(cc0|cc zero) [1 0] [universal]",)),
    ("mpl-2.0", 0.95, ("mozilla public license", "[version|v] 2 0")),
    ("unlicense", 0.95, ("free and unencumbered software", "released into the public domain")),
    ("mit-text", 1.0, license_texts.MIT),
    ("isc-text", 1.0, license_texts.ISC),
    ("bsd-2-text", 1.0, license_texts.BSD_2),
    ("bsd-3-text", 1.0, license_texts.BSD_3),
    ("apache-2.0-text", 1.0, license_texts.APACHE_2),
    # openings alone: whatever follows may have been altered
    ("mit-opening", 0.7, license_texts.MIT[:6]),
    ("isc-opening", 0.7, license_texts.ISC[:2]),
    ("bsd-opening", 0.7, license_texts.BSD_2[:3]),
    ("copyright-reserved", 0.6, ("copyright [c] {6} all rights reserved",)),
)
#: A text without any of these has no place where a phrase or template could stand. Each is within one word,
#: for words may be parted by any punctuation.
TRIGGER = re.compile(rb"licen|permission|redistribution|unencumbered|cc0|zero|copyright")
KEEP = bytes(c + 32 if 0x41 <= c <= 0x5A else c if c >= 0x80 or chr(c).isalnum() else 0x20 for c in range(256))


class Automaton:
    """Words from state to state. Edges: (word or None for any, to); jumps: moves that read nothing."""

    def __init__(self, markup: str):
        self.edges: list[list[tuple[bytes | None, int]]] = [[]]
        self.jumps: list[list[int]] = [[]]
        signs = re.findall(r"[\[\](){}|]|[^\s\[\](){}|]+", markup)
        self.final, rest = self._sequence(signs, 0, 0)
        if rest != len(signs):
            raise ValueError(f"unbalanced template: {markup}")
        self.start = self._closed({0})
        self.first = {w for s in self.start for w, _ in self.edges[s]}

    def _new(self) -> int:
        self.edges.append([])
        self.jumps.append([])
        return len(self.edges) - 1

    def _sequence(self, signs: list[str], at: int, state: int) -> tuple[int, int]:
        while at < len(signs) and signs[at] not in ")]|}":
            sign = signs[at]
            if sign in "([":
                end, at = self._new(), at + 1
                if sign == "[":
                    self.jumps[state].append(end)
                while True:
                    begin = self._new()
                    self.jumps[state].append(begin)
                    last, at = self._sequence(signs, at, begin)
                    self.jumps[last].append(end)
                    if at >= len(signs):
                        raise ValueError("a region isn't closed")
                    at += 1
                    if signs[at - 1] != "|":
                        break
                state = end
            elif sign == "{":
                end = self._new()
                self.jumps[state].append(end)
                for _ in range(int(signs[at + 1])):
                    to = self._new()
                    self.edges[state].append((None, to))
                    self.jumps[to].append(end)
                    state = to
                state, at = end, at + 3
            else:
                to = self._new()
                self.edges[state].append((sign.encode(), to))
                state, at = to, at + 1
        return state, at

    def _closed(self, states: set[int]) -> frozenset[int]:
        todo, seen = list(states), set(states)
        while todo:
            for to in self.jumps[todo.pop()]:
                if to not in seen:
                    seen.add(to)
                    todo.append(to)
        return frozenset(seen)

    def match(self, words: list[bytes], at: int) -> int:
        """The end of the longest place that begins at word at, or -1."""
        states, end, n = self.start, -1, at
        while states:
            if self.final in states:
                end = n
            if n == len(words):
                break
            word = words[n]
            states = self._closed({to for s in states for w, to in self.edges[s] if w is None or w == word})
            n += 1
        return end


class Scanner:
    def __init__(self, templates=TEMPLATES, phrases=PHRASES):
        self.phrases = [(p.encode().split(), label) for p, label in phrases]
        self.automata = [(label, score, Automaton(" ".join(parts))) for label, score, parts in templates]
        self.by_word: dict[bytes | None, list[int]] = {}
        for i, (_, _, a) in enumerate(self.automata):
            for w in a.first:
                self.by_word.setdefault(w, []).append(i)

    def scan(self, text: str) -> tuple[int, list[tuple[str, int, int, float]], list[tuple[str, int, int, float]]]:
        """Words in all; base places; template places, leftmost and longest for each template."""
        data = text.encode()
        words = data.translate(KEEP).split()
        low = data.lower()
        if not TRIGGER.search(low):
            return len(words), [], []
        base, found = [], []
        free = [0] * len(self.automata)
        always = self.by_word.get(None, [])
        for at, word in enumerate(words):
            for parts, label in self.phrases:
                if word == parts[0] and words[at : at + len(parts)] == parts:
                    base.append((label, at, at + len(parts), 0.5))
            for i in always + self.by_word.get(word, []):
                if at >= free[i]:
                    label, score, automaton = self.automata[i]
                    end = automaton.match(words, at)
                    if end > at:
                        found.append((label, at, end, score))
                        free[i] = end
        return len(words), base, found


def scan_licenses(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates=TEMPLATES, phrases=PHRASES) -> DataFrame:
    """Per row: id, n_words, base and found (label, first word, end, score of every place)."""
    kind = df.select(id_col).dtypes[0][1]
    place = "array<struct<label string, first long, end long, score double>>"

    def kernel(scanner: Scanner, keys: list, texts: list) -> tuple:
        scans = [scanner.scan(t or "") for t in texts]
        named = lambda places: [dict(zip(("label", "first", "end", "score"), p)) for p in places]
        return keys, [s[0] for s in scans], [named(s[1]) for s in scans], [named(s[2]) for s in scans]

    return map_rows(df.select(id_col, text_col), kernel, f"`{id_col}` {kind}, n_words long, base {place}, found {place}", lambda: Scanner(templates, phrases))


def query(spark, sf_dir: str) -> DataFrame:
    d = scan_licenses(table(spark, sf_dir, "documents"))
    labels = lambda *c: F.array_join(F.array_sort(F.array_distinct(F.concat(*(F.transform(x, lambda p: p["label"]) for x in c)))), ",")
    return d.select(
        "doc_id",
        "n_words",
        F.size("base").cast("long").alias("n_base"),
        F.array_min(F.transform("base", lambda p: p["first"])).alias("first_word"),
        F.array_max(F.transform("base", lambda p: p["first"])).alias("last_word"),
        labels("base").alias("base_labels"),
        labels("base", "found").alias("labels"),
        F.coalesce(F.array_max(F.transform(F.concat("base", "found"), lambda p: p["score"])), F.lit(0.0)).alias("score"),
    )
