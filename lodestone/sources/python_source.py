"""Python source that may not parse: statement by statement, what is wrong becomes ``pass``, line numbers stay.

Statements are told apart by line ends outside strings and brackets, and nest by indentation. A statement that the
interpreter's parser refuses is dropped alone; a refused header of a block keeps its block, and a ``def`` or ``class`` its name.
"""

from __future__ import annotations

import ast
import re
from typing import NamedTuple

_TOKEN = re.compile(
    r"""(?P<string>("{3}|'{3})(?:\\.|(?!\2).)*\2|"(?:\\.|[^"\\\n])*"|'(?:\\.|[^'\\\n])*')"""
    r"""|(?P<comment>\#[^\n]*)|(?P<open>[(\[{])|(?P<close>[)\]}])|(?P<joined>\\\n)|(?P<end>\n)|[^"'\#()\[\]{}\\\n]+|.""",
    re.S,
)
#: Lines that begin a statement even where a bracket before them was never closed.
_ANEW = re.compile(r"(?:(?:async\s+)?def|class|import|from|@)\b|@")
#: Clauses that go on with the block before them.
_CLAUSE = re.compile(r"(?:elif|else|except|finally)\b")
_HEADER = re.compile(r"(?:async\s+)?(?:def|class|for|while|if|elif|else|try|except|finally|with|match|case)\b")
_NAMED = re.compile(r"((?:async\s+)?def|class)\s+([^\W\d]\w*)")


class Statement(NamedTuple):
    """A logical line: its first line (from 0) and the line after its last, its indentation, its text without that."""

    start: int
    stop: int
    indent: int
    text: str


def _width(line: str) -> int:
    blank = line[: len(line) - len(line.lstrip(" \t\f"))]
    return len(blank.rpartition("\f")[2].expandtabs(8))


def statements(lines: list[str]) -> list[Statement]:
    """The logical lines of a source, in order; blank ones and comments left out."""
    out: list[Statement] = []
    src = "\n".join(lines) + "\n"
    line = depth = start = 0
    said = False

    def close(stop: int) -> None:
        if said:
            text = "\n".join(lines[start:stop])
            out.append(Statement(start, stop, _width(lines[start]), text.lstrip(" \t\f")))

    for m in _TOKEN.finditer(src):
        kind = m.lastgroup
        if kind == "end":
            line += 1
            if depth and line < len(lines):
                after = lines[line]
                if _ANEW.match(after.lstrip()) and _width(after) <= _width(lines[start]):
                    depth = 0
            if not depth:
                close(line)
                start, said = line, False
            continue
        if kind == "comment":
            continue
        said = said or bool(m[0].strip())
        line += m[0].count("\n")
        depth = depth + 1 if kind == "open" else max(0, depth - 1) if kind == "close" else depth
    return out


def _straightened(lines: list[str]) -> list[Statement]:
    """The statements, each indented by its depth of blocks in ``lines`` too: one that is indented deeper without a header, or
    less than its block but more than the block around it, belongs to the block before it."""
    out: list[Statement] = []
    stack, header = [0], False
    for s in statements(lines):
        if header and s.indent > stack[-1]:
            stack.append(s.indent)
        while s.indent < stack[-1] and len(stack) > 1 and s.indent <= stack[-2]:
            stack.pop()
        lines[s.start] = " " * (len(stack) - 1) + lines[s.start].lstrip(" \t\f")
        out.append(s._replace(indent=len(stack) - 1))
        header = bool(_HEADER.match(s.text))
    return out


def _parses(text: str) -> bool:
    try:
        ast.parse(text)
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return False
    return True


def _chunk(lines: list[str], some: list[Statement]) -> str:
    """Statements as a source of their own: indented ones below a header."""
    text = "\n".join(lines[some[0].start : some[-1].stop])
    return f"if 1:\n{text}\n" if some[0].indent else f"{text}\n"


def _repaired_header(text: str) -> str:
    """A header that stands for a refused one."""
    named = _NAMED.match(text)
    if named:
        return f"{named[1]} {named[2]}" + ("(): " if named[1] != "class" else ":")
    word = re.match(r"\w*", text)[0]
    if word == "for":
        return "for _ in ():"
    return f"{word} 1:" if word in ("elif", "while") else "except Exception:" if word == "except" else f"{word}:" if word in ("else", "finally", "try") else "if 1:"


def _header_parses(text: str) -> bool:
    word = re.match(r"\w*", text)[0]
    before = {"elif": "if 1:\n pass\n", "else": "if 1:\n pass\n", "except": "try:\n pass\n", "finally": "try:\n pass\n"}.get(word, "")
    after = "\nfinally:\n pass\n" if word == "try" else "\n"
    return _parses(f"{before}{text}\n pass{after}")


def _mend(lines: list[str], some: list[Statement]) -> None:
    """Replace in ``lines`` what does not parse among these statements, which are of one block and those below."""

    def put(s: Statement, text: str) -> None:
        indent = lines[s.start][: len(lines[s.start]) - len(lines[s.start].lstrip(" \t\f"))]
        lines[s.start : s.stop] = [indent + text, *[""] * (s.stop - s.start - 1)]

    at = 0
    while at < len(some):
        head = some[at]
        stop = at + 1
        # A block is its header, what is indented deeper, and the clauses and decorated definitions that belong to it.
        while stop < len(some) and (
            some[stop].indent > head.indent
            or some[stop].indent == head.indent and (_CLAUSE.match(some[stop].text) or some[stop - 1].text.startswith("@") and some[stop - 1].indent == head.indent)
        ):
            stop += 1
        part = some[at:stop]
        at = stop
        if _parses(_chunk(lines, part)):
            continue
        k = 0
        while k < len(part):
            s, below = part[k], k + 1
            while below < len(part) and part[below].indent > head.indent:
                below += 1
            if below == k + 1:
                if s.text.startswith("@"):
                    if not _parses(f"{s.text}\ndef f(): pass\n"):
                        put(s, "@_")
                elif not _parses(f"{s.text}\n"):
                    put(s, f"{_repaired_header(s.text)} pass" if _NAMED.match(s.text) else "pass")
            else:
                if not _header_parses(s.text):
                    put(s, _repaired_header(s.text))
                _mend(lines, part[k + 1 : below])
            k = below


def parse(src: str) -> ast.Module | None:
    """The tree of a source. Where it does not parse, of what is left after dropping refused statements; null if nothing is."""
    try:
        return ast.parse(src)
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        pass
    lines = re.sub(r"\r\n?", "\n", src.replace("\0", "").removeprefix("\ufeff")).split("\n")
    try:
        _mend(lines, _straightened(lines))
        mended = "\n".join(lines) + "\n"
        if _parses(mended):
            return ast.parse(mended)
        # What still does not fit together goes, top-level block by block.
        kept = [""] * len(lines)
        tops = [s for s in statements(lines)]
        starts = [k for k, s in enumerate(tops) if not s.indent and not _CLAUSE.match(s.text) and not (k and tops[k - 1].text.startswith("@"))]
        for a, b in zip(starts, [*starts[1:], len(tops)], strict=True):
            block = slice(tops[a].start, tops[b - 1].stop)
            if _parses("\n".join(lines[block]) + "\n"):
                kept[block] = lines[block]
        return ast.parse("\n".join(kept) + "\n")
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return None
