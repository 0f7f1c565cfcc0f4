"""The part of YAML that run configurations and front matter use.

Nested mappings and lists in block style, lists and mappings in flow style, quoted and plain scalars over
several lines, literal and folded blocks, comments. Anything else (anchors, tags, several documents)
raises ValueError, so nothing is dropped without a word.
"""

from __future__ import annotations

import re

NUMBER = re.compile(r"[-+]?(0|[1-9][0-9]*)")
REAL = re.compile(r"[-+]?([0-9]+\.[0-9]*|\.[0-9]+|[0-9]+)([eE][-+]?[0-9]+)?")
KEY = re.compile(r"""("(?:[^"\\]|\\.)*"|'(?:[^']|'')*'|[^\s#\[\]{}&*!|>%@`,"'?:-][^#]*?|[-?:][^\s#][^#]*?)\s*:(?=\s|$)""")
ESCAPES = {"n": "\n", "t": "\t", "r": "\r", "0": "\0", '"': '"', "\\": "\\", "/": "/", " ": " "}


def scalar(text: str):
    """A plain scalar's value: null, a flag, a number or a text."""
    if text in ("", "~", "null", "Null", "NULL"):
        return None
    if text.lower() in ("true", "false"):
        return text.lower() == "true"
    if NUMBER.fullmatch(text):
        return int(text)
    if REAL.fullmatch(text):
        return float(text)
    if text.lower() in (".inf", "+.inf", "-.inf", ".nan"):
        return float(text.lower().replace(".", ""))
    if text[0] in "&*!|>%@`?" or text.startswith("- "):
        raise ValueError(f"not supported: {text[:40]}")
    return text


class _Flow:
    """A value on one line, which may be a flow list or mapping."""

    def __init__(self, text: str):
        self.text, self.at = text, 0

    def space(self) -> None:
        while self.at < len(self.text) and self.text[self.at] in " \t\n":
            self.at += 1

    def value(self, ends: str = ""):
        self.space()
        c = self.text[self.at : self.at + 1]
        if c == "[":
            return self.items("]", lambda: self.value(",]"))
        if c == "{":
            return dict(self.items("}", self.pair))
        if c and c in "'\"":
            return self.quoted(c)
        begin = self.at
        while self.at < len(self.text) and self.text[self.at] not in (ends or "\0"):
            if self.text.startswith(" #", self.at):
                break
            if ends and self.text.startswith(": ", self.at) and ":" in ends:
                break
            self.at += 1
        return scalar(self.text[begin : self.at].strip())

    def items(self, end: str, read) -> list:
        self.at += 1
        out = []
        while True:
            self.space()
            if self.at >= len(self.text):
                raise ValueError(f"not closed: {self.text[:40]}")
            if self.text[self.at] == end:
                self.at += 1
                return out
            out.append(read())
            self.space()
            if self.text[self.at : self.at + 1] == ",":
                self.at += 1

    def pair(self) -> tuple:
        key = self.value(":,}")
        self.space()
        if self.text[self.at : self.at + 1] != ":":
            return key, None
        self.at += 1
        return key, self.value(",}")

    def quoted(self, sign: str) -> str:
        out, self.at = [], self.at + 1
        while self.at < len(self.text):
            c = self.text[self.at]
            if sign == "'" and self.text.startswith("''", self.at):
                out.append("'")
                self.at += 2
            elif c == sign:
                self.at += 1
                return "".join(out)
            elif sign == '"' and c == "\\":
                e = self.text[self.at + 1 : self.at + 2]
                size = {"x": 2, "u": 4, "U": 8}.get(e, 0)
                if not size and e not in ESCAPES:
                    raise ValueError(f"unknown escape: {self.text[:40]}")
                out.append(chr(int(self.text[self.at + 2 : self.at + 2 + size], 16)) if size else ESCAPES[e])
                self.at += 2 + size
            else:
                out.append(c)
                self.at += 1
        raise ValueError(f"not closed: {self.text[:40]}")


def _one(text: str):
    flow = _Flow(text)
    found = flow.value()
    flow.space()
    rest = flow.text[flow.at :]
    if rest and not rest.startswith("#"):
        raise ValueError(f"unexpected: {rest[:40]}")
    return found


def _bare(line: str) -> bool:
    return not line.strip() or line.lstrip().startswith("#")


def _indent(line: str) -> int:
    return len(line) - len(line.lstrip(" "))


class _Block:
    def __init__(self, text: str):
        self.lines, self.at = text.split("\n"), 0

    def skip(self) -> None:
        while self.at < len(self.lines) and _bare(self.lines[self.at]):
            self.at += 1

    def node(self, least: int):
        """The value that begins at the next line, if that is indented by least or more."""
        self.skip()
        if self.at == len(self.lines) or (depth := _indent(self.lines[self.at])) < least:
            return None
        line = self.lines[self.at]
        if "\t" in line[: len(line) - len(line.lstrip())] or line.startswith(("---", "...", "%")):
            raise ValueError(f"not supported: {line[:40]}")
        body = line[depth:]
        if body == "-" or body.startswith("- "):
            return self.sequence(depth)
        if KEY.match(body):
            return self.mapping(depth)
        self.at += 1
        return self.inline(body, depth - 1)

    def sequence(self, depth: int) -> list:
        out = []
        while True:
            self.skip()
            if self.at == len(self.lines) or _indent(self.lines[self.at]) != depth or not re.match(r"-( |$)", self.lines[self.at][depth:]):
                break
            body = self.lines[self.at][depth + 1 :]
            inner = body.lstrip(" ")
            if _bare(body):
                self.at += 1
                out.append(self.node(depth + 1))
            elif KEY.match(inner) or re.match(r"-( |$)", inner):  # a mapping or list that begins beside the dash
                self.lines[self.at] = " " * (depth + 1 + len(body) - len(inner)) + inner
                out.append(self.node(depth + 1))
            else:
                self.at += 1
                out.append(self.inline(inner, depth))
        return out

    def mapping(self, depth: int) -> dict:
        out: dict = {}
        while True:
            self.skip()
            if self.at == len(self.lines) or _indent(self.lines[self.at]) != depth:
                break
            body = self.lines[self.at][depth:]
            m = KEY.match(body)
            if not m or re.match(r"-( |$)", body):
                break
            key = _one(m.group(1)) if m.group(1)[0] in "'\"" else m.group(1)
            rest = body[m.end() :].strip()
            self.at += 1
            if _bare(rest):
                self.skip()
                same = self.at < len(self.lines) and _indent(self.lines[self.at]) == depth and re.match(r"-( |$)", self.lines[self.at][depth:])
                out[key] = self.node(depth if same else depth + 1)
            else:
                out[key] = self.inline(rest, depth)
        return out

    def more(self, depth: int) -> list[str]:
        """The following lines that are blank or indented by more than depth."""
        begin = self.at
        while self.at < len(self.lines) and (not self.lines[self.at].strip() or _indent(self.lines[self.at]) > depth):
            self.at += 1
        return self.lines[begin : self.at]

    def inline(self, text: str, depth: int):
        """A value that begins beside its key or dash and may go on in lines indented by more than depth."""
        if m := re.fullmatch(r"([|>])([-+]?)\s*(#.*)?", text):
            lines = self.more(depth)
            inner = min((_indent(x) for x in lines if x.strip()), default=0)
            lines = [x[inner:] for x in lines]
            body = "\n".join(lines)
            if m.group(1) == ">":
                body = re.sub(r"(?<=[^\n])\n(?=[^\n ])", " ", body.rstrip("\n")) + "\n" * (len(body) - len(body.rstrip("\n")))
                body = re.sub(r"\n(\n+)(?=[^\n ])", r"\1", body)
            kept = body.rstrip("\n")
            return kept if m.group(2) == "-" else body + "\n" if m.group(2) == "+" else kept + "\n" if kept else ""
        lines = [text, *(x.strip() for x in self.more(depth) if not x.strip().startswith("#"))]
        while len(lines) > 1 and not lines[-1]:
            lines.pop()
        joined = "".join(x + ("" if i == len(lines) - 1 else "\n" if not lines[i + 1] else " " if x else "") for i, x in enumerate(lines))
        return _one(joined)


def parse_yaml(text: str):
    """The value of a YAML text; an empty one is null."""
    block = _Block(text.replace("\r\n", "\n"))
    found = block.node(0)
    block.skip()
    if block.at < len(block.lines):
        raise ValueError(f"unexpected: {block.lines[block.at][:40]}")
    return found
