"""Strong components against Tarjan's algorithm, and the rounds they take."""

import math
import random

from lodestone.operators import cycles


def tarjan(pairs):
    """id -> least id of its component, for components of two or more."""
    goes = {}
    for s, t in pairs:
        goes.setdefault(s, []).append(t)
        goes.setdefault(t, [])
    index, low, stack, on, out = {}, {}, [], set(), {}
    for root in goes:
        if root in index:
            continue
        index[root] = low[root] = len(index)
        stack.append(root)
        on.add(root)
        work = [(root, iter(goes[root]))]
        while work:
            v, rest = work[-1]
            for w in rest:
                if w not in index:
                    index[w] = low[w] = len(index)
                    stack.append(w)
                    on.add(w)
                    work.append((w, iter(goes[w])))
                    break
                if w in on:
                    low[v] = min(low[v], index[w])
            else:
                work.pop()
                if work:
                    low[work[-1][0]] = min(low[work[-1][0]], low[v])
                if low[v] == index[v]:
                    part = []
                    while not part or part[-1] != v:
                        part.append(stack.pop())
                        on.discard(part[-1])
                    if len(part) > 1:
                        out |= dict.fromkeys(part, min(part))
    return out


def name(i):
    return f"n{i:05d}"


def check(spark, pairs):
    pairs = [(name(s), name(t)) for s, t in pairs]
    edges = spark.createDataFrame([("x", s, t) for s, t in pairs], "corpus string, s string, t string")
    found, rounds = cycles.strong_components(edges)
    assert {r["id"]: r["component"] for r in found.collect()} == tarjan(pairs)
    n = len({x for p in pairs for x in p})
    assert rounds <= 4 * math.log2(n), (rounds, n)


def test_descending_cycle(spark):
    n = 1024
    check(spark, [(0, n), *((i, i - 1) for i in range(n, 0, -1))])


def test_chain_of_two_cycles(spark):
    m = 500
    check(spark, [p for i in range(m) for p in [(2 * i, 2 * i + 1), (2 * i + 1, 2 * i), (2 * i + 1, 2 * i + 2)]])


def test_random_graph(spark):
    rng = random.Random(300)
    check(spark, [(rng.randrange(300), rng.randrange(300)) for _ in range(330)])


def test_no_cycles_none_at_all_and_several_corpora(spark):
    schema = "corpus string, s string, t string"
    none, rounds = cycles.strong_components(spark.createDataFrame([("x", "a", "b"), ("x", "b", "c"), ("x", "c", "c")], schema))
    assert none.count() == 0 and rounds == 0
    assert cycles.strong_components(spark.createDataFrame([], schema))[0].count() == 0
    rows = [("x", "a", "b"), ("x", "b", "a"), ("x", "b", "a"), ("y", "b", "a"), ("y", "a", "c"), ("y", "c", "b")]
    found = cycles.strong_components(spark.createDataFrame(rows, schema))[0]
    assert {(r["corpus"], r["id"], r["component"]) for r in found.collect()} == {("x", "a", "a"), ("x", "b", "a"), ("y", "a", "a"), ("y", "b", "a"), ("y", "c", "a")}


def test_a_step_plans_few_reads_of_the_labels(spark, monkeypatch):
    """Steps in one plan multiply it: the driver holds a few reads at any time, not four to the power of the steps."""
    leaves, write = [], cycles.materialize

    def counted(df, label):
        leaves.append(df._jdf.queryExecution().analyzed().collectLeaves().size())
        return write(df, label)

    monkeypatch.setattr(cycles, "materialize", counted)
    check(spark, [p for i in range(40) for p in [(2 * i, 2 * i + 1), (2 * i + 1, 2 * i), (2 * i + 1, 2 * i + 2)]])
    assert max(leaves) <= 16
