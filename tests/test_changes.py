"""The history of builds against plain set differences."""

import random

from lodestone.operators import changes

BUILD, NODE, EDGE = "corpus string, build string, saved_at long", "corpus string, build string, id string, path string", "corpus string, build string, s string, t string, rel string"


def test_history_by_set_differences(spark):
    rng = random.Random(4)
    builds = [(c, f"b{k}", 100 - k) for c in ("x", "y") for k in range(5)] + [("z", "b0", 1)]
    nodes = [(c, b, i, rng.choice([None, "p.py", f"{i}.py"])) for c, b, _ in builds for i in "abcdef" if rng.random() < 0.5] * 2
    edges = [(c, b, s, t, rng.choice(["calls", "contains"])) for c, b, _ in builds for s in "abc" for t in "abc" if rng.random() < 0.4]
    nodes.append(("x", "gone", "q", "q.py"))  # a build that is not listed
    frames = spark.createDataFrame(builds + builds[:2], BUILD), spark.createDataFrame(nodes, NODE), spark.createDataFrame(edges, EDGE)
    expected = set()
    for c in "xyz":
        order = sorted((at, b) for d, b, at in builds if d == c)
        for (_, one), (_, two) in zip(order, order[1:], strict=False):
            held = []
            for b in (one, two):
                own = {("node", i, None, None, None, None) for d, e, i, _ in nodes if (d, e) == (c, b)} | {("file", None, p, None, None, None) for d, e, _, p in nodes if (d, e) == (c, b) and p}
                held.append(own | {("edge", None, None, s, t, r) for d, e, s, t, r in edges if (d, e) == (c, b) and r != "contains"})
            expected |= {(c, one, two, *x, "added") for x in held[1] - held[0]} | {(c, one, two, *x, "removed") for x in held[0] - held[1]}
    rows = [tuple(r) for r in changes.history(*frames).collect()]
    assert len(rows) == len(set(rows)) and set(rows) == expected and expected
    counted = {(r["corpus"], r["build"], r["what"]): (r["added"], r["removed"]) for r in changes.summary(changes.history(*frames), frames[0]).collect()}
    assert len(counted) == 2 * 4 * 3
    for (c, b, what), (added, removed) in counted.items():
        assert added == sum(r[0] == c and r[2] == b and r[3] == what and r[-1] == "added" for r in expected)
        assert removed == sum(r[0] == c and r[2] == b and r[3] == what and r[-1] == "removed" for r in expected)
    assert changes.history(frames[0], frames[1].where("false"), frames[2].where("false")).count() == 0


def test_the_older_build_is_before(spark):
    builds = spark.createDataFrame([("x", "new", 9), ("x", "old", 1), ("x", "twin", 9)], BUILD)
    picked = spark.createDataFrame([("x", "new", "old"), ("x", "old", "new"), ("x", "old", "old"), ("x", "old", "none"), ("x", "twin", "new")], "corpus string, one string, other string")
    assert sorted((r["before"], r["after"]) for r in changes.ordered(picked, builds).collect()) == [("new", "twin"), ("old", "new"), ("old", "new")]
