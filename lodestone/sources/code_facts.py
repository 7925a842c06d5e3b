"""Facts about source files: declarations, imports, calls, annotations. Names are resolved elsewhere, by joins.

A file at a time: Python by the interpreter's own parser behind ``python_source``, JavaScript and TypeScript by the reader in ``javascript``.
"""

from __future__ import annotations

import ast

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .javascript import javascript_facts
from .python_source import parse

#: One table for all facts: what is null depends on the sort of fact.
FACT = "corpus string, path string, fact string, owner string, name string, module string, alias string, line int, text string"
_NAMES = [part.split()[0] for part in FACT.split(", ")]
_TYPES = [pa.string()] * 7 + [pa.int32(), pa.string()]


def _docstring(node, fact) -> None:
    body = node.body
    if body and isinstance(body[0], ast.Expr) and isinstance(body[0].value, ast.Constant) and isinstance(body[0].value.value, str):
        text = body[0].value.value.strip().split("\n")[0].strip()
        fact("rationale", body[0].lineno, text=text if len(text) <= 77 else text[:77] + "…")


def _names(annotation):
    return {n.id for n in ast.walk(annotation) if isinstance(n, ast.Name)} if annotation else set()


def python_facts(path: str, src: str) -> list[dict]:
    """Facts of one file; where it does not parse, of all statements that do.

    owner is the dotted name of the declaration that a fact stands in, empty for the file itself.
    """
    tree = parse(src)
    if tree is None:
        return []
    facts: list[dict] = []

    def to(owner):
        return lambda kind, line, **rest: facts.append({"fact": kind, "owner": owner, "line": line, **rest})

    for node in ast.walk(tree):
        if isinstance(node, ast.Import):
            for item in node.names:
                to("")("import", node.lineno, module=item.name, alias=item.asname or item.name.split(".")[0])
        elif isinstance(node, ast.ImportFrom):
            module = "." * node.level + (node.module or "")
            to("")("from", node.lineno, module=module)
            for item in node.names:
                if item.name.isidentifier():
                    to("")("symbol", node.lineno, module=module, name=item.name)
    _docstring(tree, to(""))

    def body(node, owner):
        add = to(owner)
        args = node.args
        marked = [a.annotation for a in (*args.posonlyargs, *args.args, *args.kwonlyargs, args.vararg, args.kwarg) if a]
        for name in sorted(set().union(*map(_names, [*marked, node.returns]))):
            add("annotation", node.lineno, name=name)
        for inner in (x for statement in node.body for x in ast.walk(statement)):
            if isinstance(inner, ast.Call):
                if isinstance(inner.func, ast.Name):
                    add("call", inner.lineno, name=inner.func.id)
                elif isinstance(inner.func, ast.Attribute):
                    of = inner.func.value.id if isinstance(inner.func.value, ast.Name) else None
                    add("method_call", inner.lineno, name=inner.func.attr, alias=of)

    def decorators(node, owner):
        for mark in node.decorator_list:
            if isinstance(mark, ast.Call) and isinstance(mark.func, ast.Attribute):
                to(owner)("decorator", mark.lineno, name=mark.func.attr)

    def first_line(node):
        return min([node.lineno, *(d.lineno for d in node.decorator_list)])

    function = (ast.FunctionDef, ast.AsyncFunctionDef)
    for node in tree.body:
        if not isinstance(node, (*function, ast.ClassDef)):
            continue
        kind = "class" if isinstance(node, ast.ClassDef) else "function"
        to("")(kind, first_line(node), name=node.name)
        _docstring(node, to(node.name))
        decorators(node, node.name)
        if kind == "function":
            body(node, node.name)
            continue
        for base in node.bases:
            name = base.id if isinstance(base, ast.Name) else base.attr if isinstance(base, ast.Attribute) else None
            if name:
                to(node.name)("base", base.lineno, name=name)
        for member in node.body:
            if isinstance(member, function):
                owner = f"{node.name}.{member.name}"
                to(node.name)("member", first_line(member), name=member.name)
                _docstring(member, to(owner))
                decorators(member, owner)
                body(member, owner)
    return [{"path": path, **f} for f in facts]


def _facts(batches, read):
    for batch in batches:
        rows = []
        for corpus, path, src in zip(*(batch.column(c).to_pylist() for c in ("corpus", "path", "src")), strict=True):
            rows += [{"corpus": corpus, **f} for f in read(path, src or "")]
        yield pa.RecordBatch.from_arrays([pa.array([r.get(c) for r in rows], t) for c, t in zip(_NAMES, _TYPES, strict=True)], _NAMES)


def _python(batches):
    yield from _facts(batches, python_facts)


def from_python(files: DataFrame) -> DataFrame:
    return files.where(F.col("path").endswith(".py")).select("corpus", "path", "src").mapInArrow(_python, FACT)


def _javascript(batches):
    yield from _facts(batches, javascript_facts)


def from_javascript(files: DataFrame) -> DataFrame:
    marked = F.col("path").rlike(r"\.(m|c)?[jt]sx?$")
    return files.where(marked).select("corpus", "path", "src").mapInArrow(_javascript, FACT)
