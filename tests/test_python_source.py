"""Python that does not parse: each wrong statement costs itself."""

import ast
import glob
import os
import random
import time

import pytest

from lodestone.sources import python_source
from lodestone.sources.code_facts import python_facts

OLD = '''"""Old module."""
import os, sys
from .tools import pick

class Agent(Base):
    """Runs."""
    @app.route("/x")
    def run(self, other: Shape):
        print "old", self.x
        self.stop()
        try:
            pick(1)
        except ValueError, e:
            raise Error, "text"
        else:
            helper(0777)
        return `x`

    def stop(self, (a, b)):
        exec "code"
        close(a)

def main(x):
    if x <> 3:
        print >>sys.stderr, "no"
    elif x == 4:
        first()
    else:
        second()
    for i in xrange 3:
        third()
    with open(x) as f, :
        fourth()
print "end"

def last():
    return 5
'''


def told(src, *kinds):
    return {(f["fact"], f["owner"], f.get("name") or f.get("module") or f.get("text")) for f in python_facts("m.py", src) if not kinds or f["fact"] in kinds}


def test_old_python_keeps_all_but_its_own_statements():
    assert {(o, n) for _, o, n in told(OLD, "function", "class", "member")} == {("", "Agent"), ("Agent", "run"), ("Agent", "stop"), ("", "main"), ("", "last")}
    assert {n for _, _, n in told(OLD, "call", "method_call")} == {"stop", "pick", "close", "first", "second", "third", "fourth"}
    assert {n for _, _, n in told(OLD, "import", "from", "symbol")} == {"os", "sys", ".tools", "pick"}
    assert {n for _, _, n in told(OLD, "rationale")} == {"Old module.", "Runs."} and {n for _, _, n in told(OLD, "decorator", "base", "annotation")} == {"route", "Base", "Shape"}
    lines = {(f["fact"], f.get("name")): f["line"] for f in python_facts("m.py", OLD)}
    assert lines["function", "last"] == 1 + OLD.split("\n").index("def last():") and lines["call", "close"] == 1 + OLD.split("\n").index("        close(a)")


def test_one_print_costs_one_statement():
    src = "def a():\n    f()\n    print 'x'\n    g()\n\ndef b():\n    h()\n"
    assert told(src) == {("function", "", "a"), ("function", "", "b"), ("call", "a", "f"), ("call", "a", "g"), ("call", "b", "h")}


@pytest.mark.parametrize(
    ("src", "functions"),
    [
        ("x = (1,\ndef f():\n    pass\ndef g():\n    pass\n", {"f", "g"}), ("def f(:\n    pass\nclass C\n    pass\ndef g():\n    pass\n", {"f", "g"}), ("\x00def f():\n  pass\n", {"f"}),
        ("def f():\n  return 1\n x = 2\ndef g(): pass\n", {"f", "g"}), ("s = '''never closed\ndef f():\n    pass\n", {"f"}), ("@@\ndef f():\n    pass\n", {"f"}), ("    indented()\ndef f():\n\tpass\n        x\n", {"f"}),
        ("else:\n    pass\ndef f(): pass", {"f"}), ("def f():\ndef g(): pass\n", {"g"}), ("\ufeffprint 1\r\ndef f():\r\n    pass\r\n", {"f"}), ("if x:\n    print 1\ndef f():\n  pass", {"f"}),
    ],
)
def test_odd_sources(src, functions):
    found = {n for k, _, n in told(src) if k == "function"}
    assert functions <= found


def test_files_that_parse_give_what_the_parser_gives():
    paths = sorted(glob.glob(os.path.join(os.path.dirname(ast.__file__), "*.py")))[:60]
    for path in paths:
        src = open(path, encoding="utf-8").read()
        assert ast.dump(python_source.parse(src)) == ast.dump(ast.parse(src))
        # Reading by statements loses nothing either: all of them, put together again, are the file's own.
        lines = src.split("\n")
        python_source._mend(lines, python_source._straightened(lines))
        assert ast.dump(ast.parse("\n".join(lines))) == ast.dump(ast.parse(src)), path


def test_a_wrong_line_anywhere_costs_little():
    rng = random.Random(1)
    path = os.path.join(os.path.dirname(ast.__file__), "argparse.py")
    lines = open(path, encoding="utf-8").read().split("\n")
    all_names = {(f["fact"], f["owner"], f["name"]) for f in python_facts("m.py", "\n".join(lines)) if f["fact"] in ("function", "class", "member")}
    simple = [s for s in python_source.statements(lines) if s.text.startswith(("return", "self.", "raise")) and s.stop == s.start + 1]
    for s in rng.sample(simple, 15):
        broken = [*lines]
        broken[s.start] = " " * s.indent + 'print "x", y'
        found = {(f["fact"], f["owner"], f["name"]) for f in python_facts("m.py", "\n".join(broken)) if f["fact"] in ("function", "class", "member")}
        assert found == all_names


def test_long_broken_sources_take_linear_time():
    began = time.time()
    many = "".join(f"def f{k}():\n    print 'x'\n    g{k}()\n" for k in range(3000))
    assert len(told(many, "call")) == 3000
    python_source.parse("(" * 50_000)
    python_source.parse("'''" * 9_999)
    assert time.time() - began < 60
