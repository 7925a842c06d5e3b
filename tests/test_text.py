"""Knowledge, mentions, search, trees, history, ingest, extraction, reports and streaming."""

import io
import math
import random
import time
import zipfile
from collections import Counter
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from lodestone.functions import text as T
from lodestone.operators import docgraph, extract, history, knowledge, mentions, search, tree
from lodestone.plans import storage
from lodestone.sources import code_facts, ingest, reports
from lodestone.sources.javascript import javascript_facts
from lodestone.streaming import builds

FILE = "corpus string, path string, src string"


def value(spark, column):
    return spark.range(1).select(column).first()[0]


def files(spark, **sources):
    return spark.createDataFrame([("x", p, s) for p, s in sources.items()], FILE)


def test_ids_and_paths(spark):
    assert value(spark, T.sanitise(F.lit("Web/Src/a-b.C "))) == "web_src_a_b_c"
    assert value(spark, T.strip_ext(F.lit("a.b/c.tar.gz"))) == "a.b/c.tar"
    assert value(spark, T.extension(F.lit("a.b/.gitignore"))) == ".gitignore"
    assert value(spark, T.ancestors(F.lit("a/b/c.py"))) == ["a", "a/b"] and value(spark, T.ancestors(F.lit("c"))) == []
    assert value(spark, T.line_of(F.lit("L12"))) == 12 and value(spark, T.line_of(F.lit("12"))) is None


def test_tokens_keep_identifiers_and_their_parts(spark):
    assert value(spark, T.tokens(F.lit("The cut_off is web.src-x, a B2."))) == ["cut_off", "cut", "off", "web.src-x", "web", "src", "b2"]


def test_match_scores_rank_tiers(spark):
    s = [value(spark, T.match_score(F.lit(t), F.lit("load"))) for t in ("load", "loader", "preLoad", "a/load", "reload", "none")]
    assert s[0] > s[1] > s[3] > s[4] and s[2] > s[4] and s[5] is None


def test_sections_and_passages(spark):
    text = "# Title\nIntro words that are long enough.\n\n## Same\n" + "word " * 60 + "\n\n## Same\n---\n\nUnder\n=====\nclosing words of this text\n"
    docs = spark.createDataFrame([("x", "d.md", text), ("x", "n.txt", "# no heading here, but plain text")], "corpus string, path string, text string")
    found = knowledge.sections(docs)
    ids = [r["section_id"] for r in found.where("path = 'd.md'").orderBy("no").collect()]
    assert ids == ["d.md#title", "d.md#same", "d.md#same-2", "d.md#under"]
    assert {r["path"]: r["title"] for r in knowledge.titles(found).collect()} == {"d.md": "Title", "n.txt": "n.txt"}
    cut = {r["pid"]: r for r in knowledge.passages(found).collect()}
    assert cut["d.md#title:0"]["line"] == 2 and cut["n.txt#s0:0"]["text"].startswith("# no")
    assert not any(r["section_id"] == "d.md#same-2" for r in cut.values()), "punctuation alone is no passage"
    nodes, edges = docgraph.section_tree(found, knowledge.titles(found))
    assert ("d.md#title", "d.md#same", "subsection") in {(r["s"], r["t"], r["rel"]) for r in edges.collect()}
    assert nodes.where("kind = 'document'").count() == 2


def test_a_long_block_stands_alone_and_is_cut(spark):
    text = "short start of it all\n\n" + "x" * 2000 + "\n\n" + "tail of the text here"
    docs = spark.createDataFrame([("x", "a.md", text)], "corpus string, path string, text string")
    assert [len(r["text"]) for r in knowledge.passages(knowledge.sections(docs)).orderBy("pid").collect()] == [21, 1600, 21]


def test_repeated_paths_are_numbered(spark):
    docs = spark.createDataFrame([("x", "a.md", 1), ("x", "a.md", 2)], "corpus string, path string, ord int")
    assert sorted(r["path"] for r in knowledge.unique_paths(docs).collect()) == ["a (2).md", "a.md"]


def test_bm25_prefers_more_terms_and_ignores_unknown_ones(spark):
    p = spark.createDataFrame([("x", "1", "h", "alpha beta gamma"), ("x", "2", "h", "alpha alpha"), ("x", "3", "h", "delta")], "corpus string, pid string, heading string, text string")
    q = spark.createDataFrame([("q", "alpha beta"), ("none", "the zeta")], "qid string, query string")
    out = knowledge.bm25(p, q).orderBy("qid", "rank").collect()
    assert [(r["qid"], r["pid"], r["hits"]) for r in out] == [("q", "1", 2), ("q", "2", 1)]


NODE = "corpus string, id string, label string, kind string, path string"
PASSAGE = "corpus string, pid string, text string"


def mentioned(spark, nodes, *texts):
    n = spark.createDataFrame([("x", *r) for r in nodes], NODE)
    p = spark.createDataFrame([("x", str(i), t) for i, t in enumerate(texts)], PASSAGE)
    return {(r["pid"], r["id"]): r for r in mentions.mentions(n, p).collect()}


def test_mentions(spark):
    nodes = [("f", "store.py", "code", "app/db/store.py"), ("u", "saveUser()", "code", "app/db/store.py"), ("r", "run()", "code", "a.py"), ("w", "walk()", "code", "a.py"), ("e", "requests", "external", None)]
    found = mentioned(spark, nodes, "see app/db/store.py now", "call saveUser here", "run it", "to walk", "use `walk()` so", "requests", "unsaveUser2")
    assert set(found) == {("0", "f"), ("1", "u"), ("4", "w")}
    assert found["0", "f"]["confidence"] == "high" and found["1", "u"]["confidence"] == "low" and found["4", "w"]["confidence"] == "high"


def test_ambiguous_and_ubiquitous_names_are_no_mentions(spark):
    twice = [("a", "saveUser()", "code", "a.py"), ("b", "saveUser()", "code", "b.py")]
    assert mentioned(spark, twice, "call saveUser") == {}
    assert mentioned(spark, twice[:1], *["call saveUser"] * 40) == {}


def test_literal_search_caps_a_file_and_stops_after_a_batch(spark):
    f = spark.createDataFrame([("x", f"{i:02}.txt", "Needle here\n" * 30) for i in range(40)], FILE)
    found = search.literal_search(f, "needle", limit=100, batch=4)
    assert search.search_summary(found).first()["matches"] == 160
    line = search.line_matches(f.limit(1), "here").first()
    assert (line["line"], line["col"], line["context"]["before"]) == (1, 7, "Needle ")


def test_palette_and_box(spark):
    n = spark.createDataFrame([("x", "1", "load()", "code", "a.py", 3.0), ("x", "2", "reload()", "code", "b.py", 9.0)], NODE + ", r double")
    paths = spark.createDataFrame([("x", "src/load.py")], "corpus string, path string")
    commands = spark.createDataFrame([("x", "c", "Open", "h", "load file")], "corpus string, id string, label string, hint string, keywords string")
    out = search.palette(n, paths, commands, " LOAD ").collect()
    assert {(r["section"], r["item"], r["rank"]) for r in out} == {("Entities", "1", 1), ("Entities", "2", 2), ("Files", "src/load.py", 1), ("Commands", "c", 1)}
    assert [r["id"] for r in search.entity_box(n, "load").orderBy("rank").collect()] == ["1", "2"] and search.entity_box(n, "l").count() == 0


def test_tree_collapses_single_folders(spark):
    paths = spark.createDataFrame([("x", p) for p in ("a/b/c/1.py", "a/b/c/2.py", "d/3.py", "top.md")], "corpus string, path string")
    entries = tree.entries(paths)
    shown = {r["path"]: (r["name"], r["head"]) for r in tree.collapsed(entries).collect()}
    assert shown == {"a/b/c": ("a/b/c", "a"), "d": ("d", "d")}
    assert [r["path"] for r in entries.where("parent = ''").orderBy("rank").collect()] == ["a", "d", "top.md"]


def test_eviction(spark):
    t = datetime(2024, 1, 1)
    rows = [(str(i), f"n{i % 5}", t + timedelta(hours=i), 10) for i in range(12)] + [("big", "z", t + timedelta(days=9), 130 * 2**20)]
    out = {r["id"]: r["doomed"] for r in history.eviction(spark.createDataFrame(rows, builds.BUILD)).collect()}
    assert all(out.values()), "the newest build alone is over the budget, and doomed ones count"
    out = {r["id"]: r["doomed"] for r in history.eviction(spark.createDataFrame(rows[:-1], builds.BUILD)).collect()}
    assert sorted(int(i) for i, gone in out.items() if gone) == [0, 1, 2, 3]


def test_signature_v1(spark):
    def fnv(text):
        h = 0x811C9DC5
        for c in text:
            h = ((h ^ ord(c)) * 0x01000193) & 0xFFFFFFFF
        return h

    nodes = spark.createDataFrame([("x", "b"), ("x", "a_1")], "corpus string, id string")
    edges = spark.createDataFrame([("x", "a_1", "b", "calls", "EXTRACTED")], "corpus string, s string, t string, rel string, conf string")
    assert int(history.signature_v1(nodes, edges).first()["version"], 36) == fnv("a_1b|1")
    other = edges.withColumn("rel", F.lit("imports"))
    assert history.signature_v2(nodes, edges).first()[1] != history.signature_v2(nodes, other).first()[1]


def test_recents(spark):
    log = spark.createDataFrame([("x", " ab ", "p", 1, 1), ("x", "c", "q", 2, 2), ("x", "ab", "p", 7, 3), ("x", "de", "r", 1, 4)], "corpus string, query string, path string, line int, stamp int")
    assert [r["query"] for r in history.recent_queries(log.select("corpus", "query", "stamp")).orderBy("rank").collect()] == ["de", "ab"]
    there = spark.createDataFrame([("x", "p")], "corpus string, path string")
    assert [(r["path"], r["line"]) for r in history.recent_files(log.select("corpus", "path", "line", "stamp"), there).collect()] == [("p", 7)]


def zipped(entries):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as archive:
        for name, text in entries.items():
            archive.writestr(name, text)
    return out.getvalue()


def test_zip_ingest(spark):
    data = zipped({"repo/a.py": "x", "repo/node_modules/b.js": "x", "repo/logo.png": "x", "repo/min.js": "y" * 30000, "repo/docs/c.md": "z"})
    found = ingest.read_zips(spark.createDataFrame([("r", bytearray(data))], "corpus string, content binary"))
    assert sorted(r["path"] for r in found.collect()) == ["a.py", "docs/c.md"]
    two = ingest.read_zips(spark.createDataFrame([("r", bytearray(zipped({"a/x.py": "1", "b/y.py": "2"})))], "corpus string, content binary"))
    assert sorted(r["path"] for r in two.collect()) == ["a/x.py", "b/y.py"]


def test_folder_ingest(spark, tmp_path):
    (tmp_path / "proj/pkg/dist").mkdir(parents=True)
    for name in ("pkg/a.py", "pkg/dist/b.py", "pkg/c.bin", "Makefile"):
        (tmp_path / "proj" / name).write_text("x = 1")
    found = ingest.read_folder(spark, f"{tmp_path}/proj")
    assert sorted((r["corpus"], r["path"]) for r in found.collect()) == [("proj", "Makefile"), ("proj", "pkg/a.py")]


def test_capture_passes_over_what_does_not_fit(spark):
    f = files(spark, **{"README.md": "r" * 60, "a.md": "x" * 50, "b.md": "y" * 30, "deep/c.md": "z" * 5, "code.py": "p" * 500})
    on = spark.createDataFrame([("x", "n", "code.py")], "corpus string, id string, path string")
    assert sorted(r["path"] for r in ingest.captured_sources(f, on, budget=100).collect()) == ["README.md", "b.md", "code.py", "deep/c.md"]


PYTHON = '''"""What it is for."""
import os
import helpers
from .core import Base, work
from pkg import tools

@app.get("/x")
def view(b: Base) -> Other:
    helpers.ping()
    tools.cut()
    return work()

class Thing(Base):
    def one(self):
        """Does one."""
        self.two()

    def two(self):
        view(1)
'''


def test_python_links(spark):
    f = files(spark, **{"pkg/m.py": PYTHON, "pkg/core.py": "class Base:\n    pass\n\ndef work():\n    pass\n", "pkg/tools.py": "def cut():\n    pass\n", "pkg/__init__.py": ""})
    facts = code_facts.from_python(f)
    links = {(r["s"], r["t"], r["rel"]) for r in extract.raw_links(f, facts).collect()}
    assert {
        ("pkg_m", "os", "imports"), ("pkg_m", "helpers", "imports"), ("pkg_m", "pkg_core", "imports_from"), ("pkg_m", "pkg_core_work", "imports"),
        ("pkg_m", "pkg_tools", "imports_from"), ("pkg_m_view", "pkg_core_work", "calls"), ("pkg_m_view", "pkg_tools_cut", "calls"),
        ("pkg_m_view", "pkg_m_py_get", "references"), ("pkg_m_view", "pkg_m_py_get", "calls"), ("pkg_m_view", "pkg_m_py_ping", "calls"),
        ("pkg_m_view", "pkg_m_py_base", "references"), ("pkg_m_view", "pkg_m_py_other", "references"), ("pkg_m_thing", "pkg_m_py_base", "inherits"),
        ("pkg_m_thing", "pkg_m_thing_one", "method"), ("pkg_m_thing_one", "pkg_m_thing_two", "calls"), ("pkg_m_thing_two", "pkg_m_view", "calls"),
        ("pkg_m_rationale_1", "pkg_m", "rationale_for"), ("pkg_m", "pkg_m_view", "contains"),
    } <= links
    labels = {r["id"]: r["label"] for r in extract.raw_nodes(f, facts).collect()}
    assert labels["pkg_m_thing"] == "Thing" and labels["pkg_m_thing_one"] == ".one()" and labels["pkg_m_rationale_1"] == "What it is for."


JAVASCRIPT = """import type { Shape } from './shapes';
import React from 'react';
import {
  draw,
  type Pen,
} from '@/lib/draw';
// import nothing from './gone';
export interface Box extends Shape {
}
export const area = (b) => {
  return helper(draw(b));
};
function helper(x) { return x; }
export class Canvas extends Base {
  paint(b) {
    area(b);
  }
}
export const App = () => {
  return <Panel a={1} />;
};
function Panel() {
}
"""


def test_javascript_links(spark):
    f = files(spark, **{"src/main.tsx": JAVASCRIPT, "src/shapes.ts": "export interface Shape {\n}\n", "src/lib/draw.ts": "export function draw(b) {\n}\n"})
    facts = code_facts.from_javascript(f)
    links = {(r["s"], r["t"], r["rel"]) for r in extract.raw_links(f, facts).collect()}
    assert {
        ("src_main", "src_shapes", "imports_type"), ("src_main", "src_shapes_shape", "imports_type"), ("src_main", "ref_react", "imports_from"),
        ("src_main", "src_lib_draw", "imports_from"), ("src_main", "src_lib_draw_draw", "imports"), ("src_main", "src_lib_draw_pen", "imports_type"),
        ("src_main_area", "src_main_helper", "calls"), ("src_main_area", "src_lib_draw_draw", "calls"), ("src_main_canvas", "base", "inherits"),
        ("src_main_canvas", "src_main_canvas_paint", "method"), ("src_main_canvas_paint", "src_main_area", "calls"), ("src_main_app", "src_main_panel", "calls"),
    } <= links
    assert not any("gone" in t for _, t, _ in links)


TYPED = r"""import React, { useState as state, type Pen } from 'react'
import * as all
  from './all';
export const area = async (
  a: number,
  b = { x: 1 },
): Promise<{ n: number }> => {
  const s = `not ${helper(`x ${inner()}`)} called()`;
  const r = /fake\\(call(/.test(s);
  return draw(a) + 'no(call())' + typed<string>("x") + obj.method(1);
}
function one() {}
boot();
export abstract class Canvas<T> extends Base implements I<{}> {
  @Input() name: string;
  private field = make(1)
  handler = (e) => { area(e) }
  constructor(private x: number) { super(); one(); }
  static async paint<T>(x: T): Promise<{ a: 1 }> { if (x) { two(x); } }
  abstract gone(): void;
}
class Second { run() { new Canvas(); one() } }
export interface Opts extends A, B<C> { readonly a: string; b?: number
  run(x: number): void }
type U = { a: 1 } | 'x'
export const enum E { A, B }
declare function sig(a: string): void;
const api = axios.create({ a: one() }), list = [1, 2], both: Map<a, b> = new Map()
const fixed = { a: 1 } as const, plain = 5;
let a1, fx = function () { return one() }
const App = () => {
  return <div>Don't (<Panel a={1} /> <ns.Foo/> {list.map(x => <Item key={x}>it's</Item>)}</div>;
};
const last = x => one(x)
two()
"""


def test_javascript_facts():
    found = javascript_facts("a.tsx", TYPED)
    named = {sort: [f["name"] for f in found if f["fact"] == sort] for sort in ("function", "class", "type", "value", "symbol", "symbol_type", "base", "property")}
    assert named == {
        "function": ["area", "one", "sig", "fx", "App", "last"], "class": ["Canvas", "Second"], "type": ["Opts", "U", "E"], "value": ["api", "list", "both"],
        "symbol": ["React", "useState"], "symbol_type": ["Pen"], "base": ["Base", "A", "B"], "property": ["a", "b", "run"],
    }
    assert [(f["owner"], f["name"]) for f in found if f["fact"] == "member"] == [("Canvas", "constructor"), ("Canvas", "paint"), ("Second", "run")]
    calls = [(f["owner"], f["name"]) for f in found if f["fact"] == "call"]
    assert set(calls) == {
        ("area", "helper"), ("area", "inner"), ("area", "draw"), ("area", "typed"), ("Canvas.constructor", "one"), ("Canvas.paint", "two"),
        ("Second.run", "one"), ("fx", "one"), ("last", "one"), ("App", "t"),
    }
    assert {f["name"] for f in found if f["fact"] == "jsx"} == {"div", "Panel", "Item"}
    assert {f["line"] for f in found if f["name"] == "paint"} == {19}


@pytest.mark.parametrize("part", ["'\\", "{", "a<", "`${", "const a = ", "/*", "class A { y(", "function f() { f(", "function f() { return a<", "let a, b, ", "interface A { b", "<i ", ")"])
def test_javascript_reading_takes_linear_time(part):
    def seconds(size):
        start = time.process_time()
        javascript_facts("a.tsx", part * (size // len(part)))
        return time.process_time() - start

    assert seconds(400_000) < 12 * max(seconds(100_000), 0.05)


def test_ambiguous_modules_resolve_to_none_or_the_nearest(spark):
    f = files(spark, **{"a/util.py": "", "b/util.py": "", "a/m.py": "import util\n", "m.py": "import util\n"})
    links = {(r["s"], r["t"]) for r in extract.raw_links(f, code_facts.from_python(f)).collect()}
    assert ("a_m", "a_util") in links and ("m", "util") in links


def test_pdf_lines(spark):
    g = [("x", "d.pdf", 1, 10.0, 700.0, 24.0, "Big"), ("x", "d.pdf", 1, 60.0, 700.4, 24.0, " title"), *(("x", "d.pdf", 1, 10.0, 600.0 - 20 * i, 11.0, f"text {i}") for i in range(5)), ("x", "d.pdf", 1, 10.0, 640.0, 14.0, "Sub")]
    out = ingest.glyph_lines(spark.createDataFrame(g, "corpus string, path string, page int, x double, y double, h double, str string")).orderBy("line").collect()
    assert [(r["text"], r["level"]) for r in out[:3]] == [("Big title", 1), ("Sub", 2), ("text 0", 0)]


def test_reports_and_builds(spark, tmp_path):
    n = spark.createDataFrame([("x", "a", "</script>", "code", "a.py", 0, 1, 3.0, 5, 6)], "corpus string, id string, label string, kind string, path string, c int, h int, r double, x int, y int")
    e = spark.createDataFrame([("x", "a", "a", 1.0, "calls", "EXTRACTED")], "corpus string, s string, t string, weight double, rel string, conf string")
    groups = spark.createDataFrame([("x", 0, "api", 1, 0)], "corpus string, community int, label string, size long, hue int")
    page = reports.map_html("a<b", n.withColumn("corpus", F.lit("a<b")), e, groups)
    assert "\\u003c/script>" in page and "<title>a&lt;b" in page
    stamp = reports.write_build(n, e, f"{tmp_path}/b")
    back, links = reports.read_build(spark, f"{tmp_path}/b", "x")
    assert back.first()["build_id"] == stamp and "weight" not in links.columns
    links.withColumn("build_id", F.lit("other")).select("s", "t", "rel", "conf", "build_id", "corpus").write.mode("append").partitionBy("corpus").parquet(f"{tmp_path}/b/edges")
    with pytest.raises(ValueError, match="different builds"):
        reports.read_build(spark, f"{tmp_path}/b")


def test_builds_stream_into_a_retained_table(spark, tmp_path):
    t = datetime(2024, 1, 1)
    for k in range(2):
        rows = [(f"{k}{i}", f"n{i}", t + timedelta(hours=10 * k + i), 5) for i in range(6)]
        spark.createDataFrame(rows, builds.BUILD).coalesce(1).write.parquet(f"{tmp_path}/in/{k}")
    for k in range(2):
        stream = spark.readStream.schema(builds.BUILD).parquet(f"{tmp_path}/in/{k}")
        q = builds.retain(stream, f"{tmp_path}/out{k}", f"{tmp_path}/c{k}").start()
        q.processAllAvailable()
        q.stop()
    assert builds.current(spark, f"{tmp_path}/out0").count() == 6
    stream = spark.readStream.schema(builds.BUILD).option("recursiveFileLookup", True).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    q = builds.retain(stream, f"{tmp_path}/out", f"{tmp_path}/c").start()
    q.processAllAvailable()
    q.stop()
    assert builds.current(spark, f"{tmp_path}/out").count() == 8
    log = spark.createDataFrame([("x", t), ("x", t + timedelta(minutes=5)), ("y", t)], "corpus string, at timestamp")
    assert {r["n"] for r in builds.activity(log).collect()} == {1, 2}


def similar(texts):
    """(s, t) -> cosine of texts of equal terms and of representatives, in plain Python."""
    bag = {i: Counter(t.split()) for i, t in texts if t}
    df = Counter(w for b in bag.values() for w in b)
    rep = {i: min(j for j, c in bag.items() if c == b) for i, b in bag.items()}
    vector = {}
    for i in set(rep.values()):
        v = {w: n * math.log(len(texts) / df[w]) for w, n in bag[i].items() if df[w] < len(texts)}
        norm = math.sqrt(sum(x * x for x in v.values()))
        vector[i] = {w: x / norm for w, x in v.items()}
    out = {(rep[i], i): 1.0 for i in bag if rep[i] != i}
    for a in vector:
        for b in vector:
            cosine = sum(x * vector[b].get(w, 0) for w, x in vector[a].items())
            if a < b and cosine >= docgraph.LEAST_COSINE:
                out[a, b] = round(cosine, 6)
    return out


@pytest.mark.parametrize(("block", "levels"), [(3, 16), (1000, 4)])
def test_similar_texts_by_plain_cosines(spark, monkeypatch, block, levels):
    monkeypatch.setattr(docgraph, "BLOCK", block)
    monkeypatch.setattr(docgraph, "LEVELS", levels)
    rng = random.Random(block)
    words = [f"term{k}" for k in range(40)]
    texts = [(f"d{k:03}", " ".join(rng.choices(words, [3] * 5 + [1] * 35, k=rng.choice([3, 8, 20])))) for k in range(60)]
    texts += [(f"e{k:03}", " ".join(reversed(texts[k % 7][1].split()))) for k in range(30)] + [("none", "")]
    df = spark.createDataFrame([("c", i, t) for i, t in texts], "corpus string, id string, text string")
    found = {(r["s"], r["t"]): r["cosine"] for r in docgraph.related(df, partners=10**6).collect()}
    expected = similar(texts)
    assert len(expected) > 30 and set(found) == set(expected)
    assert all(abs(found[k] - v) < 1e-5 for k, v in expected.items())


@pytest.mark.parametrize("others", [0, 7])
def test_equal_texts_are_linked_however_few_there_are(spark, others):
    rows = [("c", f"a{k}", "solar panels feed the grid") for k in range(3)] + [("c", f"b{k}", f"word{k} alone{k}") for k in range(others)]
    found = docgraph.related(spark.createDataFrame(rows, "corpus string, id string, text string")).collect()
    assert {(r["s"], r["t"], r["cosine"]) for r in found} == {("a0", "a1", 1.0), ("a0", "a2", 1.0)}


def test_mentions_take_the_surest_confidence(spark):
    rows = [("c", "p1", "n", "low"), ("c", "p2", "n", "high"), ("c", "p3", "n", "medium"), ("c", "p4", "m", "medium"), ("c", "p5", "m", "low")]
    found = mentions.by_node(spark.createDataFrame(rows, "corpus string, pid string, id string, confidence string")).collect()
    assert {(r["id"], r["passages"], r["confidence"], r["first_pid"]) for r in found} == {("n", 3, "high", "p1"), ("m", 2, "medium", "p4")}


def test_capture_by_the_greedy_fold(spark):
    rng = random.Random(8)
    files = [("c", "/".join(["d"] * rng.randrange(3) + [f"f{k}.md"]), "x" * rng.choice([1, 5, 30, 60, 90])) for k in range(40)]
    none = spark.createDataFrame([], "corpus string, id string, path string")
    df = spark.createDataFrame(files, "corpus string, path string, src string")
    spent, kept = 0, set()
    for _, path, src in sorted(files, key=lambda f: (f[1].count("/"), f[1])):
        if spent + len(src) <= 300:
            spent += len(src)
            kept.add(path)
    assert {r["path"] for r in ingest.captured_sources(df, none, budget=300).collect()} == kept


def test_running_sums_over_ranges(spark):
    rows = [("a", k, k % 5 + 1) for k in range(100)] + [("b", k, 1) for k in range(7)]
    found = storage.running_sum(spark.createDataFrame(rows, "g string, k long, v long").repartition(7), "g", ["k"], "v", "sum").collect()
    assert {(r["g"], r["k"]): r["sum"] for r in found} == {(g, k): sum(v for h, j, v in rows if h == g and j <= k) for g, k, _ in rows}


def test_builds_are_deleted_by_id_or_all(spark):
    saved = spark.createDataFrame([("a", 1), ("b", 2), (None, 3)], "id string, bytes long")
    gone = spark.createDataFrame([("a",), ("x",), (None,)], "id string")
    assert sorted(r["bytes"] for r in history.without(saved, gone).collect()) == [2, 3]
    assert history.without(saved).count() == 0


def test_links_between_corpora_are_judged_within_the_pair(spark):
    nodes = spark.createDataFrame(
        [("a", "n1", "parseTree()", "code", "a.py"), ("b", "n2", "parseTree()", "code", "b.py"), ("b", "n3", "parseTree()", "code", "c.py"), ("c", "n4", "parseTree", "external", None)],
        "corpus string, id string, label string, kind string, path string",
    )
    said = spark.createDataFrame([("d", "p", "Call parseTree here."), ("e", "q", "Or parseTree there.")], "corpus string, pid string, text string")
    pairs = spark.createDataFrame([("a", "d"), ("a", "d"), ("b", "d"), ("a", "e"), ("c", "d"), ("a", "f")], "code string, docs string")
    assert {(r["code"], r["docs"], r["pid"], r["id"]) for r in mentions.linked(nodes, said, pairs).collect()} == {("a", "d", "p", "n1"), ("a", "e", "q", "n1")}
    assert {tuple(r) for r in mentions.unlinkable(nodes, said, pairs).collect()} == {("c", "d", "no entities"), ("a", "f", "no passages")}
    assert mentions.linked(nodes, said, pairs.where("false")).count() == 0
