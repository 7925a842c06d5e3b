"""Hits and nearest nodes against a linear scan."""

import math
import random

import pytest

from lodestone.operators import spatial

NODE, POINT = "corpus string, id string, x double, y double, r double", "corpus string, point long, x double, y double"


def scan(nodes, points, scale=None):
    out = {}
    for c, p, x, y in points:
        found = []
        for d, i, nx, ny, r in nodes:
            if d == c and None not in (nx, ny, x, y):
                d2 = (nx - x) ** 2 + (ny - y) ** 2
                if scale is None or d2 < max(r or 0, 12 / scale) ** 2:
                    found.append((d2, i))
        if found:
            out[c, p] = (min(found)[1], round(math.sqrt(min(found)[0]), 6))
    return out


def both(spark, nodes, points):
    return spark.createDataFrame(nodes, NODE), spark.createDataFrame(points, POINT)


def told(df):
    return {(r["corpus"], r["point"]): (r["id"], r["distance"]) for r in df.collect()}


@pytest.mark.parametrize("kind", ["spread", "clumps", "line", "one place", "few"])
def test_nearest_by_a_linear_scan(spark, kind):
    rng = random.Random(kind)
    place = {
        "spread": lambda: (rng.randrange(400), rng.randrange(400)), "clumps": lambda: (rng.choice([0, 5000]) + rng.gauss(0, 3), rng.choice([0, 9000]) + rng.gauss(0, 3)),
        "line": lambda: (rng.randrange(300), 7), "one place": lambda: (3, 3), "few": lambda: (rng.randrange(9), rng.randrange(9)),
    }[kind]
    nodes = [("m", f"n{k}", *map(float, place()), 1.0) for k in range(2 if kind == "few" else 300)] + [("other", "o", 1.0, 1.0, None), ("m", "lost", None, 2.0, 1.0)]
    points = [("m", k, rng.uniform(-9000, 9000), rng.uniform(-9000, 9000)) for k in range(60)] + [("m", 100 + k, *map(float, place())) for k in range(60)]
    points += [("other", 1, 0.0, 0.0), ("none", 2, 0.0, 0.0), ("m", 900, None, 1.0)]
    assert told(spatial.nearest(*both(spark, nodes, points))) == scan(nodes, points)


def test_hits_of_discs_of_any_size(spark):
    rng = random.Random(2)
    nodes = [("m", f"n{k}", rng.uniform(-500, 500), rng.uniform(-500, 500), rng.choice([None, 0.5, 20.0, 64.0, 1000.0])) for k in range(80)]
    points = [("m", k, rng.uniform(-900, 900), rng.uniform(-900, 900)) for k in range(200)] + [("m", 500, nodes[0][2] + 24, nodes[0][3])]
    for scale in (0.5, 3.0):
        assert told(spatial.exact_hit(*both(spark, nodes, points), scale)) == scan(nodes, points, scale)


def test_no_nodes_no_points(spark):
    none, point = both(spark, [("m", "n", 1.0, 1.0, 1.0)], [("m", 1, 1.0, 1.0)])
    assert spatial.nearest(none.where("false"), point).count() == 0 and spatial.nearest(none, point.where("false")).count() == 0
    assert spatial.exact_hit(none.where("false"), point).count() == 0


def test_places_that_repeat_are_searched_once(spark, monkeypatch):
    """Nodes and points crowd in few places: what is written and joined follows the places, not their product."""
    rng = random.Random(7)
    nodes = [("a", f"n{i:04d}", float(7 * (i % 5)), float(11 * (i % 5)), float(5 + i % 3)) for i in range(2000)]
    points = [("a", p, float(rng.randrange(-2, 32)), float(3 * (p % 4))) for p in range(3000)]
    n, p = both(spark, nodes, points + points[:50])
    assert all(found.count() == found.select("point").distinct().count() for found in (spatial.hit_test(n, p), spatial.exact_hit(n, p)))
    assert told(spatial.nearest(n, p)) == scan(nodes, points)
    assert told(spatial.hit_test(n, p)) == told(spatial.exact_hit(n, p)) == scan(nodes, points, 1.0)
    rows, write = [], spatial.materialize
    monkeypatch.setattr(spatial, "materialize", lambda df, label: rows.append((out := write(df, label)).count()) or out)
    spatial.nearest(n, p).count()
    assert max(rows) <= 5 * 34 * 4
