"""Sinks: tables, and small reports put together from bounded results."""

from __future__ import annotations

import html
import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MOST_MAP_EDGES, LEGEND = 20_000, 24


def write_build(nodes: DataFrame, edges: DataFrame, folder: str) -> str:
    """Nodes and edges of all corpora, partitioned by corpus and stamped with one build id; edges without weight."""
    stamp = build_id(nodes, edges)
    for name, table in (("nodes", nodes), ("edges", edges.drop("weight"))):
        table.withColumn("build_id", F.lit(stamp)).write.mode("overwrite").partitionBy("corpus").parquet(f"{folder}/{name}")
    return stamp


def write_json(nodes: DataFrame, edges: DataFrame, folder: str) -> DataFrame:
    """Both tables as lines of JSON by corpus, with all columns that they have (places on a map too), and the manifest, which is
    returned: corpus, nodes, edges, communities, build_id. Null fields are left out; a corpus of edges only is listed too."""
    stamp = build_id(nodes, edges)
    for name, table in (("nodes", nodes), ("edges", edges)):
        table.write.mode("overwrite").partitionBy("corpus").json(f"{folder}/{name}")
    groups = F.count_distinct("c") if "c" in nodes.columns else F.lit(0).cast("long")
    counted = nodes.groupBy("corpus").agg(F.count("*").alias("nodes"), groups.alias("communities"))
    counted = counted.join(edges.groupBy("corpus").agg(F.count("*").alias("edges")), "corpus", "full")
    manifest = counted.select("corpus", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("nodes", "edges", "communities")], F.lit(stamp).alias("build_id"))
    manifest.write.mode("overwrite").json(f"{folder}/manifest")
    return nodes.sparkSession.read.schema(manifest.schema).json(f"{folder}/manifest")


def build_id(nodes: DataFrame, edges: DataFrame, parameters: str = "") -> str:
    """Twelve hex digits from the content of both tables, whatever the order of rows."""
    parts = [
        t.select(F.xxhash64(F.lit(name), *t.columns).alias("h")).agg(F.bit_xor("h"), F.count("*"), F.sum(F.col("h").bitwiseAND((1 << 40) - 1)))
        for name, t in (("n", nodes), ("e", edges))
    ]
    both = parts[0].unionAll(parts[1]).collect()
    spark = nodes.sparkSession
    text = ":".join(str(x) for row in both for x in row) + parameters
    return spark.range(1).select(F.substring(F.sha1(F.lit(text)), 1, 12)).first()[0]


def read_build(spark, folder: str, corpus: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of one build; refuses tables of different builds."""
    nodes, edges = spark.read.parquet(f"{folder}/nodes"), spark.read.parquet(f"{folder}/edges")
    stamps = {row[0] for t in (nodes, edges) for row in t.select("build_id").distinct().limit(2).collect()}
    if len(stamps) > 1:
        raise ValueError(f"nodes and edges come from different builds: {sorted(stamps)}")
    if corpus is not None:
        nodes, edges = nodes.where(F.col("corpus") == corpus), edges.where(F.col("corpus") == corpus)
    return nodes, edges


def write_sources(files: DataFrame, folder: str) -> None:
    files.write.mode("overwrite").partitionBy("corpus").parquet(folder)


def _rows(table: DataFrame, *order: str) -> list[dict]:
    return [r.asDict() for r in table.orderBy(*order).collect()]


def _table(head: list[str], rows: list[list]) -> list[str]:
    """A Markdown table, or one line where there is no row."""
    if not rows:
        return ["(none)", ""]
    line = lambda cells: "| " + " | ".join("" if c is None else str(c).replace("|", "\\|") for c in cells) + " |"
    return [line(head), line(["-"] * len(head)), *map(line, rows), ""]


def insights_report(corpus: str, totals: DataFrame, hubs: DataFrame, coupling: DataFrame, cycles: DataFrame, unused: DataFrame, entries: DataFrame, counts: tuple[int, int], on: str) -> str:
    """What stands out in a corpus, as Markdown tables of top-k results, which bounds what is collected. ``counts``: all
    callables without a caller, and those of them that something outside may start; ``on``: the date."""
    top = lambda t, *cols: [[r[c] for c in cols] for r in _rows(t.where(F.col("corpus") == corpus), "rank")]
    size = _rows(totals.where(F.col("corpus") == corpus), "corpus")[0]
    out = [f"# Structure of {corpus}, {on}", "", *_table(["entities", "of them callable", "communities"], [[size["nodes"], size["callables"], size["communities"]]])]
    out += ["## Where most links arrive", "", *_table(["entity", "links", "place"], top(hubs, "label", "uses", "path"))]
    out += ["## Entities whose links enter several communities", "", *_table(["entity", "communities", "first of them", "place"], top(coupling, "label", "reaches", "reaches_into", "path"))]
    out += ["## Entities that depend on each other in a ring", "", *_table(["first entity", "in the ring"], top(cycles, "component", "size"))]
    out += [f"## Callables without a caller: {counts[0]}, and {counts[1]} that may be started from outside", ""]
    out += [*_table(["callable", "place", "line"], top(unused, "label", "path", "loc")), *_table(["started from outside", "why", "place"], top(entries, "label", "why", "path"))]
    return "\n".join(out)


def impact_report(corpus: str, reached: DataFrame, nodes: DataFrame, roots: list[str], depth: int, direction: str = "in", most: int = 1000) -> str:
    """What a change of ``roots`` may touch, as Markdown: a table of counts by distance, then the first ``most`` entities of
    each distance by label. ``direction`` out: what the roots need themselves."""
    named = reached.where(F.col("corpus") == corpus).join(nodes.select("corpus", "id", "label", "path"), ["corpus", "id"], "left")
    tally = _rows(named.groupBy("depth").agg(F.count("*").alias("n"), F.count_if("certain").alias("sure")), "depth")
    what = "Users" if direction == "in" else "Needs"
    out = [f"# {what} of {', '.join(roots)} in {corpus}", "", f"Links followed: {depth}. Distances with a lower second figure hold entities that only guessed links lead to.", ""]
    out += _table(["distance", "entities", "by links read from source"], [[r["depth"], r["n"], r["sure"]] for r in tally])
    for r in tally:
        some = _rows(named.where(F.col("depth") == r["depth"]).orderBy("label", "id").limit(most), "label", "id")
        out += [f"## Distance {r['depth']}", "", *_table(["entity", "place", "link", "certainty"], [[x["label"] or x["id"], x["path"], x["via"], "read" if x["certain"] else "guessed"] for x in some])]
    return "\n".join(out)


def diff_report(corpus: str, changes: dict[str, DataFrame], drift: DataFrame, most: int = 40) -> str:
    """A Markdown report of two builds: counts of each sort of change, the first ``most`` of each, and drift."""
    out = [f"# {corpus} — what changed", ""]
    for name, table in changes.items():
        mine = table.where(F.col("corpus") == corpus)
        for r in _rows(mine.groupBy("change").agg(F.count("*").alias("n")), "change"):
            out.append(f"- {name} {r['change']}: {r['n']}")
            keys = [c for c in table.columns if c not in ("corpus", "change")]
            some = mine.where(F.col("change") == r["change"]).orderBy(*keys).limit(most).collect()
            out += ["  - " + " ".join(str(row[c]) for c in keys if row[c] is not None) for row in some]
    out += ["", "## Drift", ""]
    found = _rows(drift.where(F.col("corpus") == corpus).orderBy("s", "t", "rel").limit(most), "s", "t", "rel")
    out += [f"- `{r['source_label']}` ({r['from_subsystem']}) now uses `{r['target_label']}` ({r['into_subsystem']}) — {r['rel'].replace('_', ' ')}" for r in found] or ["_None._"]
    return "\n".join(out) + "\n"


def _script_json(value) -> str:
    text = json.dumps(value, ensure_ascii=False)
    return text.replace("<", "\\u003c").replace("\u2028", "\\u2028").replace("\u2029", "\\u2029")


_PAGE = """<!doctype html>
<html lang="en"><head><meta charset="utf-8"><title>%(title)s — code map</title>
<style>html,body,canvas{margin:0;width:100%%;height:100%%;background:#101418}</style></head>
<body><canvas id="map"></canvas><script>
const data = %(data)s;
const canvas = document.getElementById("map"), g = canvas.getContext("2d");
const at = new Map(data.nodes.map(n => [n.i, n]));
function draw() {
  canvas.width = innerWidth; canvas.height = innerHeight;
  const k = Math.min(innerWidth, innerHeight) / (data.side || 1);
  g.strokeStyle = "#334"; g.beginPath();
  for (const [s, t] of data.links) { const a = at.get(s), b = at.get(t);
    if (a && b) { g.moveTo(a.x * k, a.y * k); g.lineTo(b.x * k, b.y * k); } }
  g.stroke();
  for (const n of data.nodes) { g.fillStyle = `hsl(${n.h || 0} 68%% 62%%)`; g.beginPath();
    g.arc(n.x * k, n.y * k, Math.max(1, (n.r || 3) * k * 4), 0, 7); g.fill(); }
}
addEventListener("resize", draw); draw();
</script></body></html>
"""


def map_html(corpus: str, nodes: DataFrame, edges: DataFrame, communities: DataFrame, most_nodes: int = 50_000) -> str:
    """One HTML file with the map of a corpus; nodes need x, y, r, c, h. Edges only up to MOST_MAP_EDGES, communities the
    LEGEND largest with the true total. Maps of more than ``most_nodes`` nodes are refused: a page can't hold them."""
    mine = nodes.where(F.col("corpus") == corpus).select(F.col("id").alias("i"), F.col("label").alias("l"), F.col("kind").alias("k"), "c", "h", "r", "x", "y", F.col("path").alias("p"))
    rows = [r.asDict() for r in mine.orderBy("i").limit(most_nodes + 1).collect()]
    if len(rows) > most_nodes:
        raise ValueError(f"more than {most_nodes} nodes")
    links = edges.where(F.col("corpus") == corpus).select("s", "t").limit(MOST_MAP_EDGES + 1).collect()
    named = communities.where(F.col("corpus") == corpus)
    legend = [r.asDict() for r in named.select("community", "label", "size", "hue").orderBy(F.desc("size"), "community").limit(LEGEND).collect()]
    data = {
        "name": corpus, "nodes": rows, "links": [list(x) for x in links] if len(links) <= MOST_MAP_EDGES else [],
        "communities": legend, "communityTotal": named.count(), "side": max([1, *(max(r["x"], r["y"]) for r in rows)]),
    }
    return _PAGE % {"title": html.escape(corpus), "data": _script_json(data)}
