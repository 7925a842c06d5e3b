"""The rules of graph, insights, blast radius, cycles and diff on hand-built graphs."""

import math
import random
from collections import deque

import pytest
from pyspark.sql import functions as F

from lodestone.operators import blast, cycles, diff, graph, insights, layout, score, spatial

NODE = "corpus string, id string, label string, kind string, path string, loc string, c int"
EDGE = "corpus string, s string, t string, rel string, conf string"
GROUP = "corpus string, community int, label string"


def nodes(spark, *rows):
    """(id, label, kind, path, community), shorter ones with defaults."""
    full = [("x", r[0], r[1] if len(r) > 1 else r[0], r[2] if len(r) > 2 else "code", r[3] if len(r) > 3 else f"{r[0]}.py", "L1", r[4] if len(r) > 4 else 0) for r in rows]
    return spark.createDataFrame(full, NODE)


def edges(spark, *rows):
    return spark.createDataFrame([("x", r[0], r[1], r[2] if len(r) > 2 else "calls", r[3] if len(r) > 3 else "EXTRACTED") for r in rows], EDGE)


def roots(spark, *ids):
    return spark.createDataFrame([("x", "r", i) for i in ids], "corpus string, root_set string, id string")


def reach(spark, e, start, depth=3, direction="in"):
    start = [start] if isinstance(start, str) else start
    return {r["id"]: r for r in blast.blast_radius(edges(spark, *e), roots(spark, *start), depth, direction).collect()}


CHAIN = [("app", "service"), ("service", "db")]


def test_what_depends_on_a_thing_is_reached_against_the_arrows(spark):
    found = reach(spark, CHAIN, "db")
    assert {i: r["depth"] for i, r in found.items()} == {"service": 1, "app": 2}
    assert found["app"]["via"] == "calls" and found["app"]["from_id"] == "service"


def test_direction_and_depth(spark):
    assert set(reach(spark, CHAIN, "app", direction="out")) == {"service", "db"}
    assert set(reach(spark, CHAIN, "db", depth=1)) == {"service"}


def test_a_cycle_ends_and_leaves_out_the_root(spark):
    assert set(reach(spark, [("a", "b"), ("b", "c"), ("c", "a")], "a", depth=6)) == {"b", "c"}


def test_an_inferred_edge_makes_all_behind_it_uncertain(spark):
    found = reach(spark, [("service", "db", "calls", "INFERRED"), ("app", "service")], "db")
    assert not found["service"]["certain"] and not found["app"]["certain"]


def test_any_certain_path_makes_certain(spark):
    found = reach(spark, [("x", "db", "calls", "INFERRED"), ("mid", "db"), ("x", "mid"), ("y", "x")], "db")
    assert found["x"]["certain"] and found["y"]["certain"] and found["x"]["depth"] == 1


def test_roots_together_and_unknown_roots(spark):
    found = reach(spark, [("a", "x"), ("b", "y"), ("y", "x")], ["x", "y"])
    assert set(found) == {"a", "b"}
    assert reach(spark, CHAIN, "nothing") == {}


def test_depth_is_that_of_a_breadth_first_search(spark):
    rng = random.Random(3)
    pairs = {(f"n{rng.randrange(40)}", f"n{rng.randrange(40)}") for _ in range(90)}
    found = reach(spark, sorted(pairs), "n1", depth=4)
    depth, queue = {"n1": 0}, deque(["n1"])
    while queue:
        here = queue.popleft()
        for s, t in pairs:
            if t == here and s not in depth:
                depth[s] = depth[here] + 1
                queue.append(s)
    assert {i: r["depth"] for i, r in found.items()} == {i: d for i, d in depth.items() if 0 < d <= 4}


def test_rings_count_by_hop(spark):
    out = blast.rings(blast.blast_radius(edges(spark, *CHAIN), roots(spark, "db"), 3)).collect()
    assert {(r["depth"], r["n"], r["n_certain"]) for r in out} == {(1, 1, 1), (2, 1, 1)}


def test_missing_ends_become_externals_and_defaults_are_filled(spark):
    own = spark.createDataFrame([("x", "a", None, "odd", None, None, 0)], NODE)
    links = spark.createDataFrame([("x", "a", "os", None, None), ("x", "a", "os", "calls", "INFERRED")], EDGE)
    found = {r["id"]: r for r in graph.canonical_nodes(own, links).collect()}
    assert found["a"]["label"] == "a" and found["a"]["kind"] == "other" and found["os"]["kind"] == "external" and len(found) == 2
    e = {r["rel"]: r for r in graph.canonical_edges(links).collect()}
    assert e["related"]["conf"] == "EXTRACTED" and e["related"]["weight"] == 0.5 and e["calls"]["weight"] == 0.45


def test_parallels_collapse_to_the_strongest_and_loops_go(spark):
    n = nodes(spark, ("a",), ("b",))
    e = graph.canonical_edges(edges(spark, ("a", "b", "calls"), ("b", "a", "contains"), ("a", "a"), ("a", "gone")))
    one = graph.collapsed_edges(n, e)
    assert [(r["a"], r["b"], r["weight"]) for r in one.collect()] == [("a", "b", 1.0)]
    assert {r["id"]: r["degree"] for r in graph.degrees(n, one).collect()} == {"a": 1, "b": 1}


def test_first_declaration_wins(spark):
    df = spark.createDataFrame([("x", "i", "late", 2), ("x", "i", "early", 1)], "corpus string, id string, label string, ord int")
    assert graph.first_by(df, ["corpus", "id"], "ord").first()["label"] == "early"


def test_hubs_leave_out_externals_and_structure(spark):
    n = nodes(spark, ("a", "a()"), ("b", "b()"), ("os", "os", "external", None))
    e = edges(spark, ("a", "os"), ("b", "os"), ("a", "b"), ("b", "a", "contains"))
    assert [(r["id"], r["uses"]) for r in insights.hubs(n, e).collect()] == [("b", 1)]


def test_unused_and_entry_points(spark):
    n = nodes(spark, ("dead", "dead()"), ("view", "view()"), ("init", ".__init__()"), ("used", "used()"), ("T", "T"))
    e = edges(spark, ("view", "app_py_get"), ("dead", "used"), ("T", "dead", "contains"))
    why = {r["id"]: r["why"] for r in insights.uncalled(n, e).collect()}
    assert why == {"dead": None, "view": "framework entry point", "init": "runtime hook"}


def test_coupling_counts_other_communities_once(spark):
    n = nodes(spark, ("a", "a()", "code", "a.py", 0), ("b", "b()", "code", "b.py", 1), ("b2", "b2()", "code", "b.py", 1), ("c", "c()", "code", "c.py", 2), ("x", "x", "external", None, 3))
    groups = spark.createDataFrame([("x", 1, "storage")], GROUP)
    out = insights.coupling(n, edges(spark, ("a", "b"), ("a", "b2"), ("a", "c"), ("a", "x"), ("b", "c")), groups).collect()
    assert [(r["id"], r["reaches"], r["reaches_into"]) for r in out] == [("a", 2, "storage, #2")]


def test_cycles_by_brute_force(spark):
    rng = random.Random(5)
    pairs = {(f"n{rng.randrange(25)}", f"n{rng.randrange(25)}") for _ in range(45)} | {("p", "q"), ("q", "p")}
    ids = {x for p in pairs for x in p}
    goes = {i: {i} for i in ids}
    for _ in ids:
        for s, t in pairs:
            goes[s] |= goes[t]
    expected = {i: min(j for j in ids if j in goes[i] and i in goes[j]) for i in ids if any(j != i and j in goes[i] and i in goes[j] for j in ids)}
    found = {r["id"]: r["component"] for r in cycles.components(edges(spark, *pairs)).collect()}
    assert found == expected
    assert cycles.components(edges(spark, ("a", "b"), ("b", "c"))).count() == 0


def test_diff(spark):
    groups = spark.createDataFrame([("x", 0, "api"), ("x", 1, "storage")], GROUP)
    n = nodes(spark, ("a", "a()", "code", "a.py", 0), ("b", "b()", "code", "b.py", 1), ("os", "os", "external", None, 1))
    none = edges(spark, ("b", "b"))
    new = edges(spark, ("b", "b"), ("a", "b"), ("a", "os"), ("a", "b", "contains"))
    assert diff.edge_diff(none, new).where("change = 'added'").count() == 2
    (one,) = diff.drift((n, none, groups), (n, new, groups)).collect()
    assert (one["s"], one["t"], one["from_subsystem"], one["into_subsystem"]) == ("a", "b", "api", "storage")
    before = nodes(spark, ("b", "b()", "code", "b.py", 1))
    assert diff.drift((before, none, groups), (n, new, groups)).count() == 0, "new code is no drift"
    assert diff.node_diff(n, n).count() == 0 and diff.file_diff(before, n).collect()[0]["path"] == "a.py"


def test_scores_have_a_total(spark):
    a, b = edges(spark, ("a", "b"), ("a", "c")), edges(spark, ("a", "b"), ("a", "d"), ("b", "a", "imports"))
    out = {r["rel"]: r for r in score.relation_scores(a, b).collect()}
    assert out["TOTAL"]["truth"] == 2 and out["TOTAL"]["ours"] == 3 and out["calls"]["recall"] == 0.5 and out["imports"]["recall"] is None


def test_layout_is_finite_boxed_and_repeatable(spark):
    clique = [(f"{g}{i}", f"{g}{j}") for g in "ab" for i in range(5) for j in range(i)] + [("a0", "b0")]
    n = nodes(spark, *[(f"{g}{i}",) for g in "ab" for i in range(5)], ("alone",))
    one = graph.collapsed_edges(n, graph.canonical_edges(edges(spark, *clique)))
    membership = layout.communities(n, one)
    parts = {r["id"]: r["c"] for r in membership.collect()}
    assert len({parts[f"a{i}"] for i in range(5)}) == 1 and parts["a1"] != parts["b1"]
    assert layout.modularity(one, membership.where("id <> 'alone'")).first()["modularity"] > 0.3
    degree = graph.degrees(n, one)
    first = {r["id"]: (r["x"], r["y"]) for r in layout.layout(n, one, degree, rounds=2).collect()}
    side = round(20000 * (11 / 8000) ** 0.5)
    assert len(first) == 11 and all(0 <= v <= side for xy in first.values() for v in xy)
    assert first == {r["id"]: (r["x"], r["y"]) for r in layout.layout(n, one, degree, rounds=2).collect()}


def test_hit_test_takes_the_nearest(spark):
    n = spark.createDataFrame([("x", "far", 605.0, 0.0, 20.0), ("x", "near", 595.0, 0.0, 3.0)], "corpus string, id string, x double, y double, r double")
    p = spark.createDataFrame([("x", 1, 598.0, 0.0), ("x", 2, 100.0, 0.0), ("x", 3, 620.0, 0.0)], "corpus string, point int, x double, y double")
    assert {r["point"]: r["id"] for r in spatial.hit_test(n, p).collect()} == {1: "near", 3: "far"}


@pytest.mark.parametrize(("rank", "hue"), [(0, 0), (1, 138), (3, 53)])
def test_hues(spark, rank, hue):
    assert spark.range(1).select(insights.hue(F.lit(rank))).first()[0] == hue


def test_unconnected_nodes_stand_evenly_outside(spark):
    rng = random.Random(6)
    rows = [("x", f"n{k:03}", 0, rng.uniform(-50, 50), rng.uniform(-50, 50)) for k in range(200)] + [("x", f"o{k:03}", 1, 0.0, 0.0) for k in range(24)] + [("y", "alone", 0, 3.0, 3.0)]
    at = spark.createDataFrame(rows, "corpus string, id string, c int, x double, y double")
    degree = spark.createDataFrame([(c, i, 0 if i[0] in "oa" else 2) for c, i, *_ in rows], "corpus string, id string, degree long")
    found = {(r["corpus"], r["id"]): (r["x"], r["y"]) for r in layout.parked(at, degree).collect()}
    tied = [(x, y) for c, i, _, x, y in rows if i[0] == "n"]
    bx, by = (sum(v) / len(tied) for v in zip(*tied, strict=True))
    edge = sorted(math.hypot(x - bx, y - by) for x, y in tied)[int(len(tied) * 0.99)]
    for k in range(24):
        x, y = found["x", f"o{k:03}"]
        assert abs((math.atan2(y - by, x - bx) - k / 24 * 2 * math.pi + math.pi) % (2 * math.pi) - math.pi) < 1e-9
        assert abs(math.hypot(x - bx, y - by) / (edge * 1.08) - 1) <= 0.03
    assert all(found["x", i] == (x, y) for c, i, _, x, y in rows if i[0] == "n") and abs(math.hypot(*found["y", "alone"]) / 1.08 - 1) <= 0.03
