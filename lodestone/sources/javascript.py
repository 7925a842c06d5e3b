"""Facts about JavaScript and TypeScript files: words, strings and brackets are told apart once, then read by statement.

Time is linear in the text, and a part that cannot be read costs its own facts only. Names are resolved by joins elsewhere.
"""

from __future__ import annotations

import re
from collections import Counter
from typing import NamedTuple

_SPACE = re.compile(r"(?:\s|//[^\n]*|/\*(?:[^*]|\*(?!/))*+(?:\*/)?)++")
_WORD = re.compile(r"[\w$#]+")
_QUOTED = {q: re.compile(rf"{q}(?:[^{q}\\\n]|\\.)*+{q}", re.S) for q in "'\""}
_REGEX = re.compile(r"/(?:[^/\\\[\n]|\\.|\[(?:[^\]\\\n]|\\.)*+\])++/\w*")
_TEMPLATE = re.compile(r"(?:[^`\\$]|\\.|\$(?!\{))*+(`|\$\{)", re.S)
_SIGN = re.compile(r"=>|\?\.(?!\d)|\.\.\.|[=!]==?|.", re.S)
_OPENER = {")": "(", "]": "[", "}": "{"}

#: A value or a name follows these words, so neither a statement nor a division is at their end.
_LEADS = set(
    "return typeof instanceof in of new delete void throw case do else yield await default export import from extends "
    "implements const let var declare abstract async as satisfies keyof function class type interface enum".split()
)
_GOES_ON = set("in of instanceof as satisfies extends implements from".split())
_DECLARES = set("import export function class abstract interface enum const let var declare async".split())
_MODIFIERS = set("static async get set public private protected readonly override abstract declare".split())
_NO_CALLS = set("if for while switch catch return function typeof new await super constructor import with do async".split())
_TYPE_BEFORE = set(": | & => < , extends is keyof".split())


class Token(NamedTuple):
    kind: str  # w(ord), s(tring), p(unctuation)
    text: str
    line: int
    depth: int
    gap: int  # before it: 0 nothing, 1 space, 2 the end of a line


def tokens(src: str) -> tuple[list[Token], dict[int, int]]:
    """The tokens and, for each opening bracket's place among them, that of its closing one. A closing bracket ends those
    opened after its partner too; one without a partner is left out of account."""
    out: list[Token] = []
    ends: dict[int, int] = {}
    stack: list[tuple[str, int]] = []
    opened, dead = Counter(), Counter()
    at, line, counted = 0, 1, 0

    def template(start):
        hit = _TEMPLATE.match(src, start)
        if hit and hit[1] == "${":
            stack.append(("${", len(out)))
            opened["${"] += 1
        return hit.end() if hit else len(src)

    while at < len(src):
        space = _SPACE.match(src, at)
        at = space.end() if space else at
        if at == len(src):
            break
        line, before, counted = line + src.count("\n", counted, at), line, at
        gap = 0 if not space else 1 if line == before or "\n" not in space[0] else 2
        c, last = src[at], out[-1] if out else None
        add = lambda kind, text, depth: out.append(Token(kind, text, line, depth, gap))  # noqa: B023, E731
        word = _WORD.match(src, at)
        if word:
            add("w", word[0], len(stack))
            at = word.end()
            continue
        after_word = last is not None and last.kind == "w" and last.text not in _LEADS
        if c in _QUOTED or c == "/":
            # No string starts within a word (don't), no pattern where a value has just ended.
            may = not (gap == 0 and after_word) if c != "/" else not (after_word or (last and (last.kind == "s" or last.text in ")]}<")))
            hit = (_QUOTED.get(c) or _REGEX).match(src, at) if may and at >= dead[c] else None
            if hit:
                add("s", hit[0], len(stack))
                at = hit.end()
                continue
            if may and at >= dead[c]:
                stop = src.find("\n", at)
                dead[c] = stop if stop >= 0 else len(src)
        if c == "`":
            add("s", "`", len(stack))
            at = template(at + 1)
            continue
        if c in _OPENER.values():
            stack.append((c, len(out)))
            opened[c] += 1
            add("p", c, len(stack) - 1)
        elif c in _OPENER:
            partners = (_OPENER[c], "${") if c == "}" else (_OPENER[c],)
            if any(opened[p] for p in partners):
                while True:
                    kind, place = stack.pop()
                    opened[kind] -= 1
                    ends[place] = len(out)
                    if kind in partners:
                        break
                if kind == "${":
                    del ends[place]
                    at = template(at + 1)
                    continue
            add("p", c, len(stack))
        else:
            sign = _SIGN.match(src, at)[0]
            add("p", sign, len(stack))
            at += len(sign) - 1
        at += 1
    return out, ends


def _ended(token: Token) -> bool:
    return token.kind == "s" or token.text in (")", "]", "}") or (token.kind == "w" and token.text not in _LEADS)


def _starts(toks: list[Token], a: int, b: int, depth: int, stops: str) -> list[tuple[int, int]]:
    """The parts of toks[a:b] at a depth: they end at ``stops`` and where a line ends that need not go on."""
    out, start = [], a
    for i in range(a, b):
        t = toks[i]
        if t.depth != depth:
            continue
        if t.kind == "p" and t.text in stops:
            out.append((start, i))
            start = i + 1
        elif i > start and t.kind == "w" and _ended(toks[i - 1]) and t.text not in _GOES_ON:
            if t.gap == 2 or (toks[i - 1].text == "}" and (depth or t.text in _DECLARES)):
                out.append((start, i))
                start = i
    return [(x, y) for x, y in [*out, (start, b)] if x < y]


class _File:
    def __init__(self, path: str, src: str):
        self.toks, self.ends = tokens(src)
        self.markup = not re.search(r"\.[mc]?ts$", path)
        self.facts: list[dict] = []
        self.angles = self.type_arguments()

    def type_arguments(self) -> dict[int, int]:
        """For each < that opens types, behind a name or before a function, the place of its >."""
        out, open_ = {}, []
        for i, t in enumerate(self.toks):
            while open_ and self.toks[open_[-1]].depth > t.depth:
                open_.pop()
            if t.kind == "p" and i:
                before = self.toks[i - 1]
                if t.text == "<" and ((t.gap == 0 and before.kind == "w") or before.text in ("=", "async")):
                    open_.append(i)
                elif t.text == ">" and open_ and self.toks[open_[-1]].depth == t.depth:
                    out[open_.pop()] = i
                elif t.text in (";", "==", "===", "!=", "!=="):
                    while open_ and self.toks[open_[-1]].depth == t.depth:
                        open_.pop()
        return out

    def behind(self, i: int, b: int) -> int:
        """The next token beside i: brackets and type arguments count as one."""
        return min(self.ends.get(i, self.angles.get(i, i)) + 1, b)

    def text(self, i: int, b: int | None = None) -> str:
        return self.toks[i].text if i < (len(self.toks) if b is None else b) and self.toks[i].kind != "s" else ""

    def add(self, fact: str, owner: str, line: int, name: str | None = None, module: str | None = None) -> None:
        self.facts.append({"fact": fact, "owner": owner, "name": name, "module": module, "line": line})

    def end(self, i: int, b: int) -> int:
        """Behind the bracket that opens at i."""
        return min(self.ends.get(i, b - 1) + 1, b)

    def body(self, i: int, b: int) -> int | None:
        """The brace from i on that opens a body, no type."""
        depth = self.toks[i].depth if i < b else 0
        while i < b and self.text(i) != ";":
            if self.text(i) == "{" and self.text(i - 1) not in _TYPE_BEFORE:
                return i
            i = self.end(i, b) if i in self.ends and self.toks[i].depth == depth else i + 1
        return None

    def arguments(self, i: int, b: int) -> int | None:
        """The parenthesis that follows the name before i, type arguments between them left out."""
        if i in self.angles:
            i = self.angles[i] + 1
        if self.text(i, b) == "?.":
            i += 1
        return i if self.text(i, b) == "(" else None

    def calls(self, owner: str, a: int, b: int) -> None:
        toks = self.toks
        for i in range(a, b):
            t = toks[i]
            if t.kind == "w" and t.text not in _NO_CALLS and not t.text[0].isdigit():
                before = toks[i - 1].text if i else ""
                at = self.arguments(i + 1, b) if i + 1 < b and toks[i + 1].text in ("(", "<", "?.") else None
                # What is followed by a body declares a method.
                if at is not None and before not in (".", "?.", "new", "function", "@") and toks[i - 2].text != "function" and self.text(self.end(at, b), b) != "{":
                    self.add("call", owner, t.line, t.text)
            elif self.markup and t.text == "<" and t.kind == "p" and i + 1 < b and toks[i + 1].kind == "w" and toks[i + 1].gap == 0:
                glued = t.gap == 0 and i > 0 and _ended(toks[i - 1]) and toks[i - 1].text != "}"
                if not glued and self.text(i + 2, b) != ".":
                    self.add("jsx", owner, t.line, toks[i + 1].text)

    def imports(self, a: int, b: int, line: int) -> None:
        toks = self.toks
        i = a + 1
        spec = next((t.text[1:-1] for t in reversed(toks[i:b]) if t.kind == "s" and t.depth == 0 and t.text[0] in "'\""), None)
        if spec is None or self.text(i, b) in ("(", "."):
            return
        only = self.text(i, b) == "type" and self.text(i + 1, b) not in ("from", ",", "=")
        self.add("import_type" if only else "import_module", "", line, module=spec)
        i += only
        if toks[i].kind == "w" and toks[i].depth == 0:
            self.add("symbol", "", line, toks[i].text, spec)
        for j in range(i, b):
            if self.text(j) == "{" and toks[j].depth == 0:
                k, end = j + 1, self.end(j, b) - 1
                while k < end:
                    stop = next((x for x in range(k, end) if self.text(x) == ","), end)
                    typed = stop - k > 1 and self.text(k) == "type" and self.text(k + 1) != "as"
                    if k + typed < stop and toks[k + typed].kind == "w":
                        self.add("symbol_type" if only or typed else "symbol", "", line, toks[k + typed].text, spec)
                    k = stop + 1
                break

    def class_(self, i: int, b: int, line: int) -> None:
        name, open_ = self.text(i, b), self.body(i + 1, b)
        self.add("class", "", line, name)
        for j in range(i + 1, b if open_ is None else open_):
            if self.text(j) == "extends" and j + 1 < b and self.toks[j + 1].kind == "w" and self.text(j + 2, b) not in (".", "("):
                self.add("base", name, self.toks[j].line, self.text(j + 1))
                break
        if open_ is None:
            return
        depth = self.toks[open_].depth + 1
        for x, y in _starts(self.toks, open_ + 1, self.end(open_, b) - 1, depth, ";"):
            while x < y and self.text(x) == "@":  # decorators, with their arguments
                x += 2
                while x < y and self.text(x) in (".", "("):
                    x = self.end(x, y) if self.text(x) == "(" else x + 2
            first = x
            while x < y and (self.text(x) == "*" or (self.text(x) in _MODIFIERS and self.text(x + 1, y) not in ("(", "<", "=", ":", "?", ""))):
                x += 1
            at = self.arguments(x + 1, y) if x < y and self.toks[x].kind == "w" else None
            if at is not None and self.body(self.end(at, y), y) is not None:
                self.add("member", name, self.toks[first].line, self.text(x))
                self.calls(f"{name}.{self.text(x)}", x + 1, y)

    def interface(self, i: int, b: int, line: int) -> None:
        name, open_ = self.text(i, b), self.body(i + 1, b)
        self.add("type", "", line, name)
        level = 0
        for j in range(i + 1, b if open_ is None else open_):
            level += (self.text(j) == "<") - (self.text(j) == ">")
            if level == 0 and self.text(j) in ("extends", ",") and self.toks[j + 1].kind == "w" and self.text(j + 2, b) != ".":
                self.add("base", name, self.toks[j + 1].line, self.text(j + 1))
        if open_ is None:
            return
        for x, y in _starts(self.toks, open_ + 1, self.end(open_, b) - 1, self.toks[open_].depth + 1, ";,"):
            if self.text(x) == "readonly" and self.text(x + 1, y) not in (":", "?", "(", ""):
                x += 1
            if self.toks[x].kind == "w" and self.text(x + 1, y) in (":", "?", "(", "<", ""):
                self.add("property", name, self.toks[x].line, self.text(x))

    def variables(self, i: int, b: int, line: int) -> None:
        toks = self.toks
        while i < b:
            value = i
            while value < b and self.text(value) not in ("=", ","):
                value = self.behind(value, b)
            stop = value = value + 1 if self.text(value, b) == "=" else value
            while stop < b and self.text(stop) != ",":
                stop = self.behind(stop, b)
            if toks[i].kind == "w" and value < stop:
                name, sort = toks[i].text, self.sort(value, stop)
                if sort:
                    self.add(sort, "", line, name)
                if sort == "function":
                    self.calls(name, value, stop)
            i = stop + 1

    def sort(self, v: int, b: int) -> str | None:
        """What the value toks[v:b] makes of its name: a function, an entity that is none, or nothing."""
        start = v
        if self.text(v) == "async":
            v += 1
        if self.text(v, b) == "function":
            return "function"
        if self.text(v, b) == "<":
            while v < b and self.text(v) != "(":
                v += 1
        if v < b and self.toks[v].kind == "w" and self.text(v + 1, b) == "=>":
            return "function"
        if self.text(v, b) == "(":
            behind = self.end(v, b)
            if self.text(behind, b) in ("=>", ":"):
                return "function"
        if any(self.toks[j].depth == self.toks[start].depth and self.text(j) in ("as", "satisfies", "?", "+", "-", "*", "|", "&", "!") for j in range(start, b)):
            return None
        if self.text(start) == "new" or (self.text(start) in ("{", "[") and self.end(start, b) == b):
            return "value"
        called = self.toks[start].kind == "w" and self.text(start) not in ("await", "typeof", "void", "delete", "yield")
        return "value" if (called or self.text(start) in ("[", "(")) and self.text(b - 1) == ")" else None

    def read(self) -> list[dict]:
        toks = self.toks
        for a, b in _starts(toks, 0, len(toks), 0, ";"):
            i, line = a, toks[a].line
            while i < b and self.text(i) in ("export", "default", "declare", "abstract", "async") and self.text(i + 1, b) not in ("=", "(", "."):
                i += 1
            word = self.text(i, b)
            if word == "const" and self.text(i + 1, b) == "enum":
                i, word = i + 1, "enum"
            if i + 1 >= b:
                continue
            following = toks[i + 1].kind == "w"
            if word == "import" and i == a:
                self.imports(a, b, line)
            elif word == "function" and (following or self.text(i + 1) == "*"):
                i += 1 + (self.text(i + 1) == "*")
                if i < b and toks[i].kind == "w":
                    self.add("function", "", line, toks[i].text)
                    at = self.arguments(i + 1, b)
                    open_ = None if at is None else self.body(self.end(at, b), b)
                    if open_ is not None:
                        self.calls(toks[i].text, i + 1, self.end(open_, b))
            elif word == "class" and following:
                self.class_(i + 1, b, line)
            elif word == "interface" and following:
                self.interface(i + 1, b, line)
            elif (word == "enum" and following) or (word == "type" and following and self.text(i + 2, b) in ("=", "<")):
                self.add("type", "", line, toks[i + 1].text)
            elif word in ("const", "let", "var"):
                self.variables(i + 1, b, line)
        return self.facts


def javascript_facts(path: str, src: str) -> list[dict]:
    """Facts of one file: top-level declarations, members, imports, and the calls and components inside of bodies.

    owner is the dotted name of the declaration that a fact stands in, empty for the file itself.
    """
    return [{"path": path, **fact} for fact in _File(path, src).read()]
