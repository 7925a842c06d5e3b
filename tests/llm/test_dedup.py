"""SimHash, suffix and substring dedup against brute force; ties, nulls, repeated rows, hot passages."""

import random

import brute
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lodestone.llm import common, repeats, simhash, substring_dedup, suffix_dedup


def corpus(seed=1, n=60):
    """Texts of a small vocabulary with exact and near copies, shared passages, odd bytes, and a line in a third of all."""
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice("abcdefgh") for _ in range(rng.randrange(1, 9))) for _ in range(150)] + ["é", "ß ß", "日本", "a\x00b", "X\x1cY"]
    passage = " ".join(rng.choice(vocabulary) for _ in range(60))
    line = " ".join(rng.choice(vocabulary) for _ in range(25))
    rows = []
    for d in range(n):
        words = [rng.choice(vocabulary) for _ in range(rng.randrange(0, 120))]
        text = rng.choice([" ", "\n", "  "]).join(words)
        if d % 3 == 0:
            text = f"{text} {line}\n{text[:40]}"
        if d % 5 == 0:
            at = rng.randrange(len(text) + 1)
            text = text[:at] + " " + passage[rng.randrange(40) :] + " " + text[at:]
        if d % 7 == 0 and rows:
            text = rng.choice(rows)[1] or ""
        if d % 11 == 0 and rows:
            text = (rng.choice(rows)[1] or "").replace("a", "e", 1)
        rows.append((d * 3 + 1, text))
    return [*rows, (2, None), (5, ""), (8, " \n "), (11, "word " * 200), (14, "word " * 200), (17, "x" * 400), (20, "x" * 120)]


@pytest.fixture(params=[1, 2])
def rows(request):
    return corpus(request.param)


def test_fingerprints_and_components(documents, rows):
    rows = [*rows, rows[0], (None, rows[1][1]), (None, "only here, under no id at all")]
    found = simhash.near_duplicates(documents(rows)).collect()
    assert len(found) == len(rows)
    prints = [(d, brute.fingerprint(t)) for d, t in rows]
    expected = sorted((str(d), f"{p:016x}", str(c)) for (d, p), c in zip(prints, brute.components(prints), strict=True))
    assert sorted((str(r["doc_id"]), r["fingerprint"], str(r["component_id"])) for r in found) == expected


def test_close_pairs_find_every_pair_in_a_dense_cluster(spark):
    rng = random.Random(4)
    centre = rng.getrandbits(64)
    keys = {centre} | {rng.getrandbits(64) for _ in range(50)}
    for _ in range(300):
        k = centre
        for _ in range(rng.randrange(1, 4)):
            k ^= 1 << rng.randrange(64)
        keys.add(k)
    signed = [k - (1 << 64) if k >> 63 else k for k in keys]
    found = {(r["a"], r["b"], r["d"]) for r in simhash.close_pairs(spark.createDataFrame([(k,) for k in signed], "fp long")).collect()}
    d = lambda a, b: ((a ^ b) & ((1 << 64) - 1)).bit_count()
    assert found == {(a, b, d(a, b)) for a in signed for b in signed if a < b and d(a, b) <= 2}


def test_one_representative_a_group(documents):
    text = " ".join(f"w{i}" for i in range(80))
    df = documents([(9, text), (4, text), (4, text), (6, "other words are here"), (None, text), (None, "alone"), (3, None), (2, "")])
    out = simhash.representatives(df)
    assert out.columns == df.columns
    assert sorted((r["doc_id"] or 0, r["text"] or "") for r in out.collect()) == [(0, "alone"), (2, ""), (4, text), (6, "other words are here")]


def test_components_by_union_find(spark):
    rng = random.Random(9)
    pairs = [(i, i + 1) for i in range(0, 60)] + [(100, 100 + i) for i in range(40)] + [(rng.randrange(200, 260), rng.randrange(200, 260)) for _ in range(40)]
    part = {x: {x} for p in pairs for x in p}
    for a, b in pairs:
        if part[a] is not part[b]:
            part[a] |= part[b]
            for x in part[b]:
                part[x] = part[a]
    found = {r["node"]: r["component"] for r in common.connected_components(spark.createDataFrame(pairs, "u long, v long")).collect()}
    assert found == {x: min(p) for x, p in part.items() if len(p) > 1}


def check_bytes(df, rows):
    found = suffix_dedup.dedup(df).collect()
    expected = brute.byte_dedup(rows)
    assert sorted((str(r["doc_id"]), r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in found) == sorted((str(d), *expected[d, t]) for d, t in rows)


def test_suffix_dedup(documents, rows):
    check_bytes(documents(rows), rows)


def test_suffix_dedup_with_null_and_repeated_ids(documents):
    a, b = "the same passage of well over fifty bytes, again and again", "another passage that is long enough to count as one here"
    rows = [(None, a), (3, a + b), (3, b), (3, b), (5, a), (None, b + a)]
    check_bytes(documents(rows), rows)


def test_hot_anchors_and_long_texts_in_pieces(documents, rows, monkeypatch):
    monkeypatch.setattr(repeats, "HOT", 2)
    monkeypatch.setattr(suffix_dedup, "PIECE", 64)
    monkeypatch.setattr(repeats, "REMEMBER", 5)
    monkeypatch.setattr(repeats, "BLOCK_ROWS", 3)
    monkeypatch.setattr(substring_dedup, "GATHER", 50)
    check_bytes(documents(rows), rows)
    found = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in substring_dedup.dedup(documents(rows)).collect()}
    assert found == brute.word_dedup(rows)


def test_substring_dedup(documents, rows):
    found = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in substring_dedup.dedup(documents(rows)).collect()}
    assert found == brute.word_dedup(rows)


def test_substring_dedup_with_null_and_repeated_rows(documents):
    a, b = " ".join(f"a{i}" for i in range(30)), " ".join(f"b{i}" for i in range(30))
    found = substring_dedup.dedup(documents([(None, a), (4, a), (4, a), (2, b + " " + b), (None, b)])).collect()
    assert sorted((str(r["doc_id"]), r["n_removed"]) for r in found) == [("2", 30), ("4", 0), ("4", 0), ("None", 30), ("None", 30)]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.binary(max_size=60).map(lambda b: bytes(x % 3 for x in b)), min_size=1, max_size=8), st.integers(1, 6))
def test_interval_expansion_finds_first_owners(texts, least):
    owner = np.arange(len(texts))
    found = suffix_dedup.first_owners(texts, owner, least)
    for t, got in zip(texts, found, strict=True):
        assert list(got) == [min(k for k, u in enumerate(texts) if t[i : i + least] in u) for i in range(len(t) - least + 1)]


@pytest.mark.parametrize("operator", [simhash.near_duplicates, simhash.representatives, suffix_dedup.dedup, substring_dedup.dedup])
def test_empty_table(documents, operator):
    assert operator(documents([(1, "a")]).where("doc_id < 0")).count() == 0


def test_words_are_split_as_bytes_are():
    texts = ["a\x1cb c", " x y", "", " lead", "tail ", "é\u0085è  z"]
    data = b"".join(t.encode() for t in texts)
    offsets = np.cumsum([0, *(len(t.encode()) for t in texts)])
    hashes, rows = substring_dedup.word_hashes(np.frombuffer(data, dtype=np.uint8), offsets)
    assert np.diff(rows).tolist() == [len(t.encode().split()) for t in texts]
    assert len(set(hashes.tolist())) == len({w for t in texts for w in t.encode().split()})


def test_words_that_differ_in_a_balanced_pattern(documents):
    """Polynomials modulo a power of two take such words for equal: letters by the parity of the bits of their place."""
    bits = ["ab"[i.bit_count() & 1] for i in range(2048)]
    first, second = "".join(bits), "".join("ab"[c == "a"] for c in bits)
    rows = [(1, " ".join([f"w{i}" for i in range(19)] + [first])), (2, " ".join([f"w{i}" for i in range(19)] + [second]))]
    assert {r["doc_id"]: r["n_removed"] for r in substring_dedup.dedup(documents(rows)).collect()} == {1: 0, 2: 0}
    assert {r["doc_id"]: r["n_removed"] for r in substring_dedup.dedup(documents([*rows, (3, rows[1][1])])).collect()} == {1: 0, 2: 0, 3: 20}
