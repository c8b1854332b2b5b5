"""The part of YAML that manifests are written in, as ordered trees: block and flow maps and lists, quoted and plain scalars,
literal and folded texts, comments. Anchors, aliases, tags and complex keys are refused (ValueError), not guessed at.

A key written twice keeps its later value. Of several documents the first that is not empty counts.
"""

from __future__ import annotations

import json
import re

_NULL, _TRUE, _FALSE = {"", "~", "null", "Null", "NULL"}, {"true", "True", "TRUE"}, {"false", "False", "FALSE"}
_KEY = re.compile(r"""((?:"(?:[^"\\]|\\.)*"|'(?:[^']|'')*'|[^\s"'#\[\]{},&*!|>%@`-][^#]*?|-[^\s#][^#]*?))\s*:(?:\s+(.*)|$)\Z""")


def scalar(text: str):
    """The value of a plain or quoted scalar."""
    if text[:1] == '"':
        try:
            return json.loads(text)
        except json.JSONDecodeError as e:
            raise ValueError(f"bad string {text}") from e
    if text[:1] == "'":
        if len(text) < 2 or text[-1] != "'":
            raise ValueError(f"open string {text}")
        return text[1:-1].replace("''", "'")
    if text[:1] in "&*!%@`|>" and text:
        raise ValueError(f"not a plain scalar: {text}")
    if text in _NULL:
        return None
    if text in _TRUE or text in _FALSE:
        return text in _TRUE
    if re.match(r"[-+]?(0|[1-9][0-9]*)\Z", text):
        return int(text)
    if re.match(r"[-+]?(?:[0-9]+\.[0-9]*|\.[0-9]+)(?:[eE][-+]?[0-9]+)?\Z", text):
        return float(text)
    return text


def _uncommented(text: str) -> str:
    """text without a comment at its end; a # inside quotes or a word is none."""
    quote = ""
    for i, c in enumerate(text):
        if quote:
            quote = "" if c == quote and not (quote == '"' and text[i - 1] == "\\") else quote
        elif c in "\"'" and (i == 0 or text[i - 1] in " [{,:"):
            quote = c
        elif c == "#" and (i == 0 or text[i - 1] in " \t"):
            return text[:i].rstrip()
    return text.rstrip()


def _flow(text: str, at: int):
    """The flow value that begins at a place, and where it ends."""
    while at < len(text) and text[at] == " ":
        at += 1
    if at < len(text) and text[at] in "[{":
        close, items = "]" if text[at] == "[" else "}", []
        at += 1
        while True:
            while at < len(text) and text[at] in " ,":
                at += 1
            if at >= len(text):
                raise ValueError(f"open flow: {text}")
            if text[at] == close:
                break
            item, at = _flow(text, at)
            if close == "}":
                found = re.compile(r"\s*:\s*").match(text, at)
                if not found:
                    raise ValueError(f"no value of {item}")
                value, at = _flow(text, found.end())
                item = (str(item), value)
            items.append(item)
        return (items if close == "]" else dict(items)), at + 1
    found = re.compile(r""""(?:[^"\\]|\\.)*"|'(?:[^']|'')*'|[^,\[\]{}:]+(?::[^\s,\[\]{}][^,\[\]{}:]*)*""").match(text, at)
    if not found:
        raise ValueError(f"no value in {text[at:]}")
    return scalar(found[0].strip()), found.end()


def _value(text: str):
    if text[:1] in "[{" and text:
        value, end = _flow(text, 0)
        if text[end:].strip():
            raise ValueError(f"more after a flow value: {text}")
        return value
    return scalar(text)


class _Lines:
    """The lines with their indents; blank lines and comments are skipped but for texts."""

    def __init__(self, text: str):
        self.raw = text.replace("\r\n", "\n").split("\n")
        self.at = 0

    def peek(self) -> tuple[int, str] | None:
        while self.at < len(self.raw):
            line = self.raw[self.at]
            body = _uncommented(line.strip())
            if body:
                if "\t" in line[: len(line) - len(line.lstrip())]:
                    raise ValueError("a tab indents")
                return len(line) - len(line.lstrip(" ")), body
            self.at += 1
        return None

    def text(self, indent: int, style: str) -> str:
        """A literal (|) or folded (>) text that stands deeper than indent."""
        rows = []
        while self.at < len(self.raw) and (not self.raw[self.at].strip() or len(self.raw[self.at]) - len(self.raw[self.at].lstrip(" ")) > indent):
            rows.append(self.raw[self.at])
            self.at += 1
        deep = min((len(r) - len(r.lstrip(" ")) for r in rows if r.strip()), default=0)
        body = "\n".join(r[deep:] for r in rows).rstrip("\n")
        if style[0] == ">":
            body = re.sub(r"(?<!\n)\n(?!\n)", " ", body).replace("\n\n", "\n")
        return body if style.endswith("-") or not body else body + "\n"


def _block(lines: _Lines, least: int):
    """The value that begins at the next line, which stands at least so deep."""
    head = lines.peek()
    if head is None or head[0] < least:
        return None
    indent, body = head
    if body == "-" or body.startswith("- "):
        out: list = []
        while (head := lines.peek()) and head[0] == indent and (head[1] == "-" or head[1].startswith("- ")):
            inner = head[1][1:].lstrip()
            if inner and (_KEY.match(inner) or inner.startswith("- ")) and inner[0] not in "[{":
                line = lines.raw[lines.at]
                lines.raw[lines.at] = line[:indent] + " " + line[indent + 1 :]
                out.append(_block(lines, indent + 1))
            else:
                lines.at += 1
                out.append(_follow(lines, inner, indent, indent + 1))
        return out
    if found := _KEY.match(body):
        table: dict = {}
        while (head := lines.peek()) and head[0] == indent and (found := _KEY.match(head[1])):
            lines.at += 1
            key = scalar(found[1])
            nested = lines.peek() if not found[2] else None
            same = nested is not None and nested[0] == indent and (nested[1] == "-" or nested[1].startswith("- "))
            table[str(key) if not isinstance(key, str) else key] = _follow(lines, found[2] or "", indent, indent if same else indent + 1)
        head = lines.peek()
        if head and head[0] >= indent and not (head[0] == indent and least == 0 and head[1] in ("---", "...")):
            raise ValueError(f"out of place: {head[1]}")
        return table
    lines.at += 1
    return _value(body)


def _follow(lines: _Lines, inner: str, indent: int, least: int):
    """The value after a key or dash: on its line, or below it."""
    if re.match(r"[|>][-+]?\Z", inner):
        return lines.text(indent, inner)
    return _value(inner) if inner else _block(lines, least)


def parse(text: str):
    """The tree of the first document that is not empty; None if all are."""
    for document in re.split(r"(?m)^(?:---|\.\.\.)[ \t]*$", text.lstrip("﻿")):
        lines = _Lines(document)
        value = _block(lines, 0)
        if lines.peek() is not None:
            raise ValueError(f"out of place: {lines.peek()[1]}")
        if value is not None:
            return value
    return None
