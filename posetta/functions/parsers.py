"""Texts parsed into rows: shell-like token lines, markdown blocks, log segments."""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_NAME = re.compile(rb"[A-Za-z0-9_]+")
_BLANK = b" \t\n\r\x0c"


def token_lines(data: bytes, variables: dict[str, str] | None = None) -> list[list[str]]:
    """Lines of tokens. Blanks part tokens, a newline ends a line unless it's escaped, and a carriage return before a
    newline belongs to it. A backslash takes the next byte as it is; single quotes take everything; in double
    quotes only \\$ is an escape. $NAME stands for a variable, or nothing if it isn't set.

    Three oddities are kept: an unquoted variable right before a blank ends its token even at a newline, which then
    doesn't end the line; a second $ right behind it is an ordinary character; and so is what follows a backslash
    right behind it, the backslash being dropped. A $ with no name behind it raises ValueError."""
    known = {k.encode(): v for k, v in (variables or {}).items()}
    lines: list[list[str]] = []
    line: list[str] = []
    i, n = 0, len(data)

    def variable(at: int) -> tuple[str, int]:
        m = _NAME.match(data, at)
        if not m:
            if at >= n:
                return "", at
            raise ValueError("a variable's name is missing")
        return known.get(m[0], ""), m.end()

    def text(b: bytes | bytearray) -> str:
        return bytes(b).decode("utf-8", "replace")

    while True:
        while i < n and data[i : i + 1] in (b" ", b"\t", b"\n", b"\r", b"\x0c"):
            i += 1
        if i >= n:
            break
        token, lit, ended = "", bytearray(), False
        quoted = False
        while i < n:
            c = data[i : i + 1]
            if quoted:
                if c == b'"':
                    quoted = False
                    i += 1
                elif c == b"\\" and i + 1 < n:
                    lit += b"$" if data[i + 1 : i + 2] == b"$" else data[i : i + 2]
                    i += 2
                elif c == b"$":
                    token, lit = token + text(lit), bytearray()
                    value, i = variable(i + 1)
                    token += value
                    if i < n and data[i : i + 1] not in (b'"', b"$"):
                        lit += data[i : i + 1]
                        i += 1
                else:
                    lit += c
                    i += 1
            elif c == b"\r":
                i += 1
                if i < n and data[i : i + 1] == b"\n":
                    i, ended = i + 1, True
                    break
                if i < n:
                    lit += b"\r" + data[i : i + 1]
                    i += 1
            elif c == b"\n":
                i, ended = i + 1, True
                break
            elif c in (b" ", b"\t", b"\x0c"):
                i += 1
                break
            elif c == b"\\":
                nxt = data[i + 1 : i + 2]
                i += 2
                if nxt in (b"\r", b"\n"):
                    while i < n and data[i] in _BLANK:
                        i += 1
                else:
                    lit += nxt
            elif c == b"'":
                end = data.find(b"'", i + 1)
                end = n if end < 0 else end
                lit += data[i + 1 : end]
                i = end + 1
            elif c == b'"':
                quoted = True
                i += 1
            elif c == b"$":
                token, lit = token + text(lit), bytearray()
                value, i = variable(i + 1)
                token += value
                if i < n and data[i] in _BLANK:
                    i += 1
                    break
                if data[i : i + 1] == b"\\":
                    i += 1
                elif i < n and data[i : i + 1] not in (b"'", b'"'):
                    lit += data[i : i + 1]
                    i += 1
            else:
                lit += c
                i += 1
        line.append(token + text(lit))
        if ended:
            lines.append(line)
            line = []
    return [*lines, line] if line else lines


def markdown_blocks(text: str) -> list[tuple[int, str, int, int, str]]:
    """(depth, kind, first line, line after the last, first line's text) of a text's blocks in order: document,
    sections by heading level, headings, fenced code, block quotes, lists and items, thematic breaks and
    paragraphs. Inline structure and tables aren't told apart."""
    lines = text.split("\n")
    out: list[tuple[int, str, int, int, str]] = [(0, "document", 0, len(lines), lines[0])]
    sections: list[int] = []
    i = 0

    def put(kind: str, lo: int, hi: int, extra: int = 0) -> None:
        out.append((1 + len(sections) + extra, kind, lo, hi, lines[lo]))

    def starts(x: str) -> str:
        if re.match(r" {0,3}(```|~~~)", x):
            return "fenced_code_block"
        if re.match(r" {0,3}#{1,6}(\s|$)", x):
            return "atx_heading"
        if re.match(r" {0,3}([-*_])[ \t]*(\1[ \t]*){2,}$", x):
            return "thematic_break"
        if re.match(r" {0,3}>", x):
            return "block_quote"
        return "list" if re.match(r" {0,3}([-*+]|\d{1,9}[.)])(\s|$)", x) else ""

    headings: list[tuple[int, int]] = []  # (line, level), those in fenced code left out
    fence = ""
    for j, x in enumerate(lines):
        mark = re.match(r" {0,3}(`{3,}|~{3,})", x)
        if fence:
            fence = "" if x.strip().startswith(fence) else fence
        elif mark:
            fence = mark[1]
        elif starts(x) == "atx_heading":
            headings.append((j, len(re.match(r" {0,3}(#+)", x)[1])))

    while i < len(lines):
        if not lines[i].strip():
            i += 1
            continue
        kind, lo = starts(lines[i]), i
        if kind == "atx_heading":
            level = len(re.match(r" {0,3}(#+)", lines[i])[1])
            while sections and sections[-1] >= level:
                sections.pop()
            hi = next((j for j, k in headings if j > i and k <= level), len(lines))
            put("section", lo, hi)
            sections.append(level)
            put(kind, lo, lo + 1)
            i += 1
        elif kind == "fenced_code_block":
            fence = re.match(r" {0,3}(`{3,}|~{3,})", lines[i])
            fence = fence[1] if fence else lines[i].strip()[:3]
            i += 1
            while i < len(lines) and not lines[i].strip().startswith(fence):
                i += 1
            i = min(len(lines), i + 1)
            put(kind, lo, i)
        elif kind == "list":
            items = []
            while i < len(lines) and (starts(lines[i]) == "list" or (lines[i].strip() and (lines[i].startswith("  ") or not starts(lines[i])))):
                if starts(lines[i]) == "list":
                    items.append(i)
                i += 1
            put(kind, lo, i)
            for a, b in zip(items, [*items[1:], i]):
                put("list_item", a, b, 1)
        elif kind == "thematic_break":
            i += 1
            put(kind, lo, i)
        else:
            i += 1
            while i < len(lines) and lines[i].strip() and (starts(lines[i]) == kind if kind else not starts(lines[i])):
                i += 1
            put(kind or "paragraph", lo, i)
    return out


def tokens_table(df: DataFrame, id_col: str, text_col: str, variables: dict[str, str] | None = None) -> DataFrame:
    """(id, line_no, tok_no, token) of each text; null gives none."""
    import pandas as pd

    kind = dict(df.dtypes)[id_col]

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(k, a, c, t) for k, x in zip(b.iloc[:, 0], b.iloc[:, 1]) if x is not None for a, line in enumerate(token_lines(x.encode(), variables)) for c, t in enumerate(line)]
            yield pd.DataFrame(rows, columns=["id", "line_no", "tok_no", "token"])

    return df.select(F.col(id_col).alias("id"), text_col).mapInPandas(parse, f"id {kind}, line_no bigint, tok_no bigint, token string").withColumnRenamed("id", id_col)


def blocks_table(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, seq, depth, kind, start, end, first) of each text's markdown blocks; null gives none."""
    import pandas as pd

    kind = dict(df.dtypes)[id_col]

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(k, i, *block) for k, x in zip(b.iloc[:, 0], b.iloc[:, 1]) if x is not None for i, block in enumerate(markdown_blocks(x))]
            yield pd.DataFrame(rows, columns=["id", "seq", "depth", "kind", "start", "end", "first"])

    return df.select(F.col(id_col).alias("id"), text_col).mapInPandas(parse, f"id {kind}, seq bigint, depth bigint, kind string, start bigint, end bigint, first string").withColumnRenamed("id", id_col)
