"""The pipeline's near-copy stage against brute force: planted near copies, hubs that are not close to all, odd rows."""

import random
from fractions import Fraction

import corpus_pipeline
import pytest
from lodestone.llm import near_copies


def shingled(text):
    words = (text or "").encode().lower().split()
    k = min(5, len(words))
    return {b" ".join(words[i : i + k]) for i in range(len(words) - k + 1)} if words else set()


def kept(rows):
    sets = [shingled(t) for _, t in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, x in enumerate(sets):
        for j in range(i):
            y = sets[j]
            if x == y or (x | y and Fraction(len(x & y), len(x | y)) >= Fraction(4, 5)):
                parent[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        least[find(i)] = min(least.get(find(i), (True, 0)), (d is None, d or 0))
    return sorted(d for none, d in least.values() if not none)


def planted(seed):
    rng = random.Random(seed)
    word = lambda: f"w{rng.randrange(3000)}"
    line, rows = [word() for _ in range(20)], []
    for _ in range(12):
        base = [word() for _ in range(rng.choice([3, 6, 30, 90, 200]))]
        for _ in range(6):
            copy = list(base)
            for _ in range(rng.randrange(0, 4)):
                copy[rng.randrange(len(copy))] = word()
            rows.append(" ".join(copy + (line if rng.random() < 0.4 else [])))
    rows += [None, "", " \n", "One two", "one  TWO"]
    rng.shuffle(rows)
    return [(3 * i + 1, t) for i, t in enumerate(rows)]


@pytest.mark.parametrize("dense", [0, 4])
def test_near_copies_leave_one_a_group(spark, documents, monkeypatch, dense):
    monkeypatch.setattr(near_copies, "DENSE", dense)
    rows = planted(5 + dense)
    out = corpus_pipeline.near_duplicates(spark, documents(rows), "").collect()
    assert sorted(r["doc_id"] for r in out) == kept(rows)
    assert len(out) < len({t for _, t in rows})


def test_a_similarity_of_four_fifths_is_enough(spark, documents):
    words = [f"w{i}" for i in range(48)]
    near, far = " ".join(words[:40] + ["x"] * 0), " ".join(words[:13] + ["y"] + words[14:40])
    rows = [(1, near), (2, " ".join(words[:49])), (3, far)]
    out = corpus_pipeline.near_duplicates(spark, documents(rows), "").collect()
    assert sorted(r["doc_id"] for r in out) == kept(rows)


def test_repeated_rows_null_ids_and_no_rows(spark, documents):
    words = " ".join(f"w{i}" for i in range(60))
    rows = [(5, words)] * 4 + [(None, words + " end")] * 3 + [(7, words + " end"), (8, None), (None, None), (9, "other text of a few words here")]
    out = corpus_pipeline.near_duplicates(spark, documents(rows), "").collect()
    assert sorted(r["doc_id"] for r in out) == [5, 8, 9]
    df = documents(rows)
    none = corpus_pipeline.near_duplicates(spark, df.where("false"), "")
    assert none.columns == df.columns and none.count() == 0


def test_tries_of_fingerprints_give_the_candidates(spark):
    """Near copies meet in the tries alone, before the exact join; unlike sets and crowded leaves make no pairs of all."""
    rng = random.Random(3)
    texts = []
    for _ in range(10):
        base = [f"w{rng.randrange(3000)}" for _ in range(120)]
        texts += [" ".join(base), " ".join(base[:50] + ["other"] + base[51:])]
    sets = [near_copies.shingles(t.encode()) for t in texts]
    crowd = 40
    rows = [(k, k, near_copies.fingerprints(s).tolist()) for k, s in enumerate(sets)] + [(100 + k, 100 + k, [7] * near_copies.TREES) for k in range(crowd)]
    met = near_copies._candidates(spark.createDataFrame(rows, "cls long, at long, t array<int>")).collect()
    pairs = {(r["u"], r["v"]) for r in met}
    assert {(k, k + 1) for k in range(0, 20, 2)} <= pairs
    assert len([p for p in pairs if p[0] < 100]) < 20  # of 190
    assert len([p for p in pairs if p[0] >= 100]) < crowd * near_copies.TREES
    assert {x for p in pairs for x in p if x >= 100} == set(range(100, 100 + crowd))
