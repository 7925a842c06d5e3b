"""The tries of the near-copy stage are as sparse at their leaves however many rows there are, and find the same pairs at any number of bits."""

import random

import pytest
from lodestone.llm import near_copies, simhash
from pyspark.sql import functions as F


def test_bits_grow_with_the_rows():
    assert near_copies.tree_bits(1 << 17) == 28 and near_copies.tree_bits(5 << 17) == 30
    for rows in (1, 1000, 44_205, 220_121, 12_000_000):
        bits = near_copies.tree_bits(rows)
        assert bits % 2 == 0 and 2**9 < 2**bits / rows <= 2**12


@pytest.mark.parametrize("bits", [8, 14, 20, 34])
def test_trees_of_any_depth_join_all_close_paths(spark, bits):
    rng = random.Random(bits)
    paths = {(tree, rng.randrange(1 << bits)) for tree in range(3) for _ in range(60)}
    paths |= {(tree, path ^ (1 << rng.randrange(bits))) for tree, path in list(paths)[:40]}
    keys = spark.createDataFrame([(t, p) for t, p in paths], "tree long, path long")
    keys = keys.select(F.expr(f"shiftleft(tree, 58) | shiftleft(path, {58 - bits})").alias("fp"))
    found = [(r["a"], r["b"], r["d"]) for r in simhash.close_pairs(keys, 1, 6, bits).collect()]
    key = {(t, p): (t << bits) | p for t, p in paths}
    want = {(min(key[x], key[y]), max(key[x], key[y]), 1) for x in paths for y in paths if x[0] == y[0] and (x[1] ^ y[1]).bit_count() == 1}
    assert set(found) == want and len(found) == len(want) >= 40
