"""Reports, JSON sinks, graph files, and small functions on columns."""

import json
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from lodestone.functions import text as T
from lodestone.operators import layout, mentions, score, search, tree
from lodestone.sources import ingest, reports


def frame(spark, schema, *rows):
    return spark.createDataFrame(list(rows), schema)


def test_insights_report(spark):
    totals = frame(spark, "corpus string, nodes long, callables long, communities long", ("x", 12, 5, 2), ("y", 1, 1, 1))
    hubs = frame(spark, "corpus string, rank int, label string, uses long, path string", ("x", 2, "b|c()", 3, None), ("x", 1, "a()", 9, "a.py"), ("y", 1, "z", 1, "z"))
    none = frame(spark, "corpus string, rank int, label string, reaches long, reaches_into string, path string, component string, size long, loc string, why string")
    lines = reports.insights_report("x", totals, hubs, none, none, none, none, (4, 2), "2024-01-01").split("\n")
    assert lines[0] == "# Structure of x, 2024-01-01" and "| 12 | 5 | 2 |" in lines
    assert lines.index("| a() | 9 | a.py |") + 1 == lines.index("| b\\|c() | 3 |  |") and "z" not in "".join(lines[9:])
    assert lines.count("(none)") == 4 and any("4, and 2" in x for x in lines)


def test_impact_report(spark):
    reached = frame(spark, "corpus string, id string, depth int, certain boolean, via string", ("x", "b", 1, True, "calls"), ("x", "c", 2, False, "imports_from"), ("y", "q", 1, True, "calls"))
    nodes = frame(spark, "corpus string, id string, label string, path string", ("x", "b", "b()", "b.py"))
    text = reports.impact_report("x", reached, nodes, ["a"], 2)
    assert text.startswith("# Users of a in x") and "| 1 | 1 | 1 |" in text and "| 2 | 1 | 0 |" in text
    assert "| b() | b.py | calls | read |" in text and "| c |  | imports_from | guessed |" in text and "q" not in text
    assert reports.impact_report("none", reached, nodes, ["a"], 2, "out").startswith("# Needs of a in none")


def test_diff_report(spark):
    nodes = frame(spark, "corpus string, id string, change string", ("x", "n1", "added"), ("x", "n2", "added"), ("y", "n3", "removed"))
    drift = frame(spark, "corpus string, s string, t string, rel string, source_label string, target_label string, from_subsystem string, into_subsystem string", ("x", "a", "b", "calls", "A", "B", "one", "two"))
    text = reports.diff_report("x", {"entities": nodes}, drift, most=1)
    assert "entities added: 2" in text and "n1" in text and "n2" not in text and "n3" not in text and "`A` (one)" in text


def test_json_sink_and_manifest(spark, tmp_path):
    nodes = frame(spark, "corpus string, id string, c int, x int, y int", ("x", "a", 0, 5, 7), ("x", "b", 1, None, None), ("y", "a", 0, 1, 1))
    edges = frame(spark, "corpus string, s string, t string, rel string", ("x", "a", "b", "calls"), ("z", "p", "q", "calls"))
    found = {r["corpus"]: r for r in reports.write_json(nodes, edges, str(tmp_path)).collect()}
    assert {c: (r["nodes"], r["edges"], r["communities"]) for c, r in found.items()} == {"x": (2, 1, 2), "y": (1, 0, 1), "z": (0, 1, 0)}
    assert {r["build_id"] for r in found.values()} == {reports.build_id(nodes, edges)}
    lines = [json.loads(x) for p in (tmp_path / "nodes/corpus=x").glob("*.json") for x in p.read_text().splitlines()]
    assert sorted(lines, key=lambda r: r["id"]) == [{"id": "a", "c": 0, "x": 5, "y": 7}, {"id": "b", "c": 1}]
    reports.write_sources(frame(spark, "corpus string, path string, src string", ("x", "a.py", "pass")), f"{tmp_path}/src")
    assert spark.read.parquet(f"{tmp_path}/src").first()["corpus"] == "x"


def test_graph_files(spark, tmp_path):
    canonical = {"nodes": [{"id": "a", "label": "A", "kind": "code", "attrs": {"path": "a.py", "loc": "L1"}}], "edges": [["a", "b", "x", "calls", "EXTRACTED"]]}
    raw = {"nodes": [{"id": "a", "label": "A", "file_type": "code", "source_file": "a.py", "source_location": "L1"}], "links": [{"source": "a", "target": "b", "relation": "calls", "confidence": "EXTRACTED"}]}
    for name, value in (("canonical", canonical), ("raw", raw)):
        (tmp_path / name).write_text(json.dumps(value))
        nodes, edges = ingest.read_canonical_json(spark, str(tmp_path / name), "c")
        assert [tuple(r) for r in nodes.collect()] == [("c", "a", "A", "code", "a.py", "L1")]
        assert [tuple(r) for r in edges.collect()] == [("c", "a", "b", "calls", "EXTRACTED")]
    for k, value in enumerate(({"nodes": []}, {"edges": []}, {"other": 1})):
        (tmp_path / f"bad{k}").write_text(json.dumps(value))
        with pytest.raises(ValueError, match="no graph"):
            ingest.read_canonical_json(spark, str(tmp_path / f"bad{k}"), "c")


def test_names_and_documents(spark):
    paths = frame(spark, "path string", ("up/My.ZIP",), (".zip",), ("folder/a/b",), ("",))
    found = paths.select(ingest.zip_name().alias("z"), ingest.folder_name().alias("f")).collect()
    assert [(r["z"], r["f"]) for r in found] == [("My", "up"), ("repo", ".zip"), ("b", "folder"), ("repo", "repo")]
    files = frame(spark, "corpus string, path string, bytes long", ("c", "r/a.md", 10), ("c", "r/b.PDF", 10), ("c", "r/node_modules/c.md", 10), ("c", "r/d.md", 10**12), ("c", "r/e.bin", 1))
    assert {r["path"] for r in ingest.document_files(files).collect()} == {"a.md", "b.PDF"}


def test_scores_counts_and_panels(spark):
    truth = frame(spark, "corpus string, source_file string, s string", ("c", "a.py", "x"), ("c", "b.md", "y"))
    known, ours = score.in_scope(truth, frame(spark, "corpus string, source_file string, s string", ("c", "a.py", "x"), ("c", "z.py", "q")))
    assert known.count() == 1 and [r["s"] for r in ours.collect()] == ["x"]
    names = frame(spark, "corpus string, path string, name string", ("c", "a", "f"), ("c", "a", "g"), ("c", "a", "g"))
    (recall,) = score.entity_recall(names, names.where("name = 'g'")).collect()
    assert (recall["truth"], recall["found"]) == (2, 1)
    assert tree.file_counts(frame(spark, "corpus string, path string", ("c", "a"), ("c", "a"), ("c", "b"))).first()["files"] == 2
    said = frame(spark, "corpus string, pid string, id string, confidence string", ("c", "p1", "n", "low"), ("c", "p2", "n", "high"), ("c", "p3", "n", "medium"))
    assert [r["pid"] for r in mentions.ranked_for_panel(said, 2).orderBy("rank").collect()] == ["p2", "p3"]
    recent = frame(spark, "corpus string, path string, rank int", ("c", "d/a.py", 2), ("c", "b.py", 1))
    commands = frame(spark, "corpus string, id string, label string", ("c", "open", "Open"))
    shown = search.without_query(recent, commands, 1).collect()
    assert {(r["section"], r["item"], r["label"]) for r in shown} == {("Recent files", "b.py", "b.py"), ("Commands", "open", "Open")}


def test_small_functions(spark):
    row = frame(spark, "t string, n long, a timestamp, b timestamp", ("<a> & \"b\" imports_from", 1536, datetime(2024, 1, 1), datetime(2024, 1, 1, 2, 30)))
    out = row.select(
        T.escape_html("t").alias("e"), T.relation_words("t").alias("w"), T.human_bytes("n").alias("k"), T.human_bytes(F.lit(12)).alias("s"), T.human_bytes(F.lit(3 << 20)).alias("m"),
        T.age("a", "b").alias("h"), T.age("b", "b").alias("now"), search.highlight("t", ["a", "imports"]).alias("marked"), layout.tuning(F.lit(3.2)).alias("low"), layout.tuning(F.lit(99.0)).alias("high"),
    ).first()
    assert out["e"] == "&lt;a&gt; &amp; &quot;b&quot; imports_from" and out["w"].endswith("imports from")
    assert (out["k"], out["s"], out["m"], out["h"], out["now"]) == ("2 KB", "12 B", "3.0 MB", "2h ago", "just now")
    assert out["marked"] == '<<mark>a</mark>> & "b" <mark>imports</mark>_from'
    assert (out["low"]["scaling"], out["low"]["gravity"], out["high"]["scaling"]) == (2.0, 1.5, 12.0)
