"""Exponion k-means against plain k-means in Python's integers."""

import hashlib
import math
import random
from collections import Counter

from lodestone.llm import clustering


def brute(rows, k, rounds, seed="2", d=64):
    kept = []
    for i, e in rows:
        if e is not None and len(e) == d and all(x is not None and math.isfinite(x) for x in e):
            kept.append((i, [max(-clustering.LARGEST, min(clustering.LARGEST, math.floor(256 * x))) for x in e]))
    order = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"{seed}:{r[0]}".encode()).hexdigest(), b"".join(x.to_bytes(4, "little", signed=True) for x in r[1])))
    cents = [v for _, v in order[:k]]
    dist = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    for turn in range(rounds + 1):
        where = [min(range(len(cents)), key=lambda j: (dist(v, cents[j]), j)) for _, v in kept]
        if turn < rounds:
            for j in range(len(cents)):
                own = [v for (_, v), w in zip(kept, where, strict=True) if w == j]
                if own:
                    cents[j] = [sum(col) // len(own) for col in zip(*own, strict=True)]
    ds = [dist(v, cents[w]) for (_, v), w in zip(kept, where, strict=True)]
    cut = lambda x: min(x, clustering.LONG)
    ds = [cut(x) for x in ds]
    by = Counter()
    for w, x in zip(where, ds, strict=True):
        by[w] += x
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in cents]
    return Counter((i, w, x, cut(by[w]), cut(sum(ds)), sha[w]) for (i, _), w, x in zip(kept, where, ds, strict=True))


def check(spark, rows, k=40, rounds=5, d=64, parts=3):
    df = spark.createDataFrame([(7, i, e, "x", 1) for i, e in rows], "n long, vec_id long, embedding array<float>, v string, cluster int").repartition(parts)
    exact = [(r["vec_id"], r["embedding"]) for r in df.collect()]  # as floats
    out = clustering.cluster(df, k=k, rounds=rounds, components=d)
    assert out.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    assert Counter(tuple(r) for r in out.collect()) == brute(exact, k, rounds, d=d)


def test_table(spark, table):
    df = table("embeddings")
    rows = [(r["vec_id"], r["embedding"]) for r in df.collect()]
    assert Counter(tuple(r) for r in clustering.cluster(df).collect()) == brute(rows, 40, 5)


def test_ties_and_repeats(spark):
    rng = random.Random(1)
    # A coarse grid: many vectors are equally near to several centroids, and many are equal.
    for k, d, n in ((7, 2, 200), (12, 3, 300), (40, 64, 90), (5, 1, 60)):
        check(spark, [(rng.randrange(60), [rng.randrange(4) / 256 for _ in range(d)]) for _ in range(n)], k, 4, d)
    check(spark, [(i, [0.5] * 64) for i in range(50)])
    check(spark, [(1, [0.1] * 64)] * 60 + [(None, [0.2] * 64)] * 3 + [(2, [0.3] * 64)])


def test_rows_that_are_not_kept(spark):
    good = [(i, [math.sin(i * j) for j in range(64)]) for i in range(30)]
    bad = [(100, None), (101, []), (102, [0.0] * 63), (103, [0.0] * 65), (104, [None] + [0.0] * 63), (105, [math.nan] + [0.0] * 63), (106, [math.inf] + [0.0] * 63), (None, [0.5] * 64)]
    check(spark, good + bad)
    assert clustering.cluster(spark.createDataFrame(bad[:7], "vec_id long, embedding array<float>")).count() == 0
    assert clustering.cluster(spark.createDataFrame([], "vec_id long, embedding array<float>")).columns[0] == "vec_id"


def test_large_components(spark):
    rng = random.Random(2)
    check(spark, [(i, [rng.choice([1e3, -1e5, 4e6, 0.1, 1e30]) * rng.random() for _ in range(4)]) for i in range(80)], 6, 3, 4)


def test_search_scans_less_than_all(spark):
    rng = random.Random(5)
    rows = [(i, [rng.uniform(-1, 1) for _ in range(2)]) for i in range(4000)]
    found = clustering.kmeans(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), components=2)
    assert found.scanned[0] == 4000 * 40 and all(4000 <= n < 0.5 * 4000 * 40 for n in [*found.scanned[2:]]), found.scanned
