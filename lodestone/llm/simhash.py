"""SimHash fingerprints, and a self-join of their binary trie within a Hamming budget."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import connected_components, discard, documents_of, fresh, join_hot, materialize, release, slices

SHINGLE = 3
SEED = 42
BUDGET = 2
BITS = 64
#: Levels of the trie that one step goes down: the children of a node are the bits of one long.
STEP = 6
#: Steps after which the pairs of nodes are written.
WRITTEN = 2


def fingerprint(text: bytes) -> int:
    """Majority bits of the XXH64 of every word shingle, repeats included; 0 without a word."""
    words = text.lower().split()  # of bytes: A-Z and the six white-space characters of ASCII only
    if not words:
        return 0
    joined = b" ".join(words)
    lengths = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts = (ends - lengths).tolist()
    k = min(SHINGLE, len(words))
    digest, hashes = xxhash.xxh64_intdigest, [0] * (len(words) - k + 1)
    for i, (a, b) in enumerate(zip(starts, ends[k - 1 :].tolist(), strict=False)):
        hashes[i] = digest(joined[a:b], SEED)
    ones = np.zeros(BITS, dtype=np.int64)
    for at in range(0, len(hashes), 1 << 16):
        part = np.array(hashes[at : at + (1 << 16)], dtype=">u8")
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(hashes)).tobytes(), "big")


def _fingerprints(batches):
    for batch in slices(batches):
        found = [fingerprint(text.encode()) for text in batch.column("text").to_pylist()]
        signed = pa.array(np.array(found, dtype=np.uint64).view(np.int64))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("key"), signed], ["doc_id", "key", "fp"])


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, key (hash of the text) and fp, the fingerprint as a signed long, of every row, repeated rows included."""
    keyed = documents_of(docs).select("doc_id", F.xxhash64("text").alias("key"), "text")
    return keyed.mapInArrow(_fingerprints, "doc_id long, key long, fp long")


def _prefix(depth: int):
    """The trie node at ``depth`` above a leaf."""
    return F.shiftrightunsigned("fp", BITS - depth) if depth else F.lit(0).cast("long")


def _children(leaves: DataFrame, depth: int, step: int) -> DataFrame:
    """Each node at ``depth``: its children ``step`` levels below, as numbers and as bits, and those with two leaves."""
    child = _prefix(depth + step).bitwiseAND(F.lit((1 << step) - 1)).cast("int")
    counted = leaves.groupBy(_prefix(depth).alias("node"), child.alias("child")).agg(F.count("*").alias("n"))
    bit = F.expr("shiftleft(1L, child)")
    return counted.groupBy("node").agg(
        F.collect_list("child").alias("children"), F.bit_or(bit).alias("there"), F.bit_or(F.when(F.col("n") > 1, bit).otherwise(0)).alias("many"),
    )


def close_pairs(keys: DataFrame, budget: int = BUDGET, root: int = 0, bits: int = BITS) -> DataFrame:
    """Pairs (a, b) of the distinct ``keys(fp)`` that differ in 1 to ``budget`` bits, with these bits' number d.

    With a ``root``, the first bits of a key are the number of a tree and ``bits`` more its path there, none beyond: only keys of
    one tree meet, and a and b are the keys without the bits beyond. The first step then takes what STEP leaves over, so the last ones, where
    the trie is sparse, are as deep below the leaves at any number of bits.

    The binary trie of the fingerprints is joined with itself from its root: a pair of nodes (a, b) stands for all pairs
    of leaves under them and carries d, the bits in which their paths differ. A step replaces it by the pairs of the
    nodes STEP levels below whose d is within the budget, and drops a node that would only meet itself: a subtree of
    one leaf. At depth t a node meets at most the nodes whose t bits differ by the budget, 1 + t + t (t - 1) / 2 for a
    budget of 2, so no node is a hot key, however the leaves crowd; pairs are most where the trie gets sparse, at about
    the logarithm of the number of leaves, and fall off below.
    """
    leaves, written = materialize(keys.select("fp"), "simhash-leaves"), None
    roots = leaves.select(_prefix(root).alias("a")).distinct() if root else keys.sparkSession.range(1).select(F.lit(0).cast("long").alias("a"))
    pairs = roots.select("a", F.col("a").alias("b"), F.lit(0).alias("d"))
    first = bits % STEP if root and bits % STEP else min(STEP, bits)
    for level, depth in enumerate([root, *range(root + first, root + bits, STEP)]):
        step = min(STEP, root + bits - depth) if level else first
        near = [[e for e in range(1 << step) if e.bit_count() <= left] for left in range(budget + 1)]
        change = F.array(*map(F.lit, near[budget]))
        for d in range(1, budget + 1):
            change = F.when(F.col("d") == d, F.array(*map(F.lit, near[budget - d]))).otherwise(change)
        nodes = _children(leaves, depth, step)
        met = pairs.join(nodes.select(F.col("node").alias("a"), "children", "many"), "a")
        met = met.join(nodes.select(F.col("node").alias("b"), "there"), "b")
        met = met.select("a", "b", "d", "many", "there", F.explode("children").alias("x"))
        met = met.select("*", F.explode(change).alias("e")).withColumn("y", F.col("x").bitwiseXOR(F.col("e")))
        met = met.where("shiftright(there, y) & 1 = 1 and (a <> b or x < y or (x = y and shiftright(many, x) & 1 = 1))")
        below = [F.shiftleft(up, step).bitwiseOR(F.col(child).cast("long")).alias(up) for up, child in (("a", "x"), ("b", "y"))]
        pairs = met.select(*below, (F.col("d") + F.bit_count("e")).cast("int").alias("d"))
        if level % WRITTEN == WRITTEN - 1:
            # A plan of all steps at once is more than a driver need hold, and keeps the shuffles of all steps on disk.
            before, written = written, materialize(pairs, "simhash-pairs")
            pairs = written
            if before is not None:
                discard(before)
            release(keys.sparkSession)
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "d")


def _grouped(docs: DataFrame, budget: int) -> tuple[DataFrame, DataFrame]:
    """The rows' fingerprints, and for each distinct one: its component (one of its fingerprints), the smallest doc_id
    of the component (null without any), the number of fingerprints linked to it and the number of its rows."""
    prints = materialize(fingerprints(docs), "simhash")
    leaves = prints.groupBy("fp").agg(F.min("doc_id").alias("least_id"), F.count("*").alias("n_rows"))
    # Leaves are numbered by their fingerprints, whose order does not follow the ids: components need the least id.
    links = materialize(close_pairs(leaves, budget), "simhash-links")
    parts = connected_components(links.select(F.col("a").alias("u"), F.col("b").alias("v")), "simhash-parts")
    parts = materialize(parts.join(leaves.select(F.col("fp").alias("node"), "least_id"), "node"), "simhash-members")
    least = parts.groupBy("component").agg(F.min("least_id").alias("component_id"))
    ends = links.select(F.col("a").alias("node")).unionByName(links.select(F.col("b").alias("node")))
    linked = parts.join(least, "component").join(ends.groupBy("node").agg(F.count("*").alias("n_links")), "node")
    linked = linked.select(F.col("node").alias("fp"), "component", "component_id", "n_links")
    found = leaves.join(linked, "fp", "left").select(
        "fp", F.coalesce("component", "fp").alias("component"), F.coalesce("component_id", "least_id").alias("component_id"),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), "n_rows",
    )
    return prints, materialize(found, "simhash-classes")


def near_duplicates(docs: DataFrame, budget: int = BUDGET) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id and n_links of every row.

    Rows of equal fingerprints are one leaf of the trie; leaves within ``budget`` bits are linked (n_links: leaves
    linked to the row's own), and component_id is the smallest doc_id reachable. Copies are never expanded to pairs,
    and no link between different fingerprints is lost.

    Null, empty and wordless texts have fingerprint zero and link to each other like any others. A row with a null
    doc_id keeps its fingerprint and takes its component; a component without any id has a null id. Repeated
    rows and repeated ids stay as they are. Further columns are ignored; an empty table gives no rows.
    """
    prints, found = _grouped(docs, budget)
    return join_hot(prints, found, "fp", "n_rows").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", "n_links"
    )


def representatives(docs: DataFrame, budget: int = BUDGET) -> DataFrame:
    """One row of ``docs`` for each component of near duplicates: that of the smallest doc_id, nulls last; among rows
    of that id the text of least hash, and one of equal rows. All columns stay."""
    prints, found = _grouped(docs, budget)
    order = F.struct(F.col("doc_id").isNull().alias("none"), F.coalesce("doc_id", F.lit(0)).alias("id"), "key")
    kept = prints.groupBy("fp").agg(F.min(order).alias("row")).join(found.select("fp", "component"), "fp")
    kept = kept.groupBy("component").agg(F.min("row").alias("row"))
    kept = kept.select(F.col("row.none").alias("__none"), F.col("row.id").alias("__id"), F.col("row.key").alias("__key"))
    on = fresh(docs, "__none", "__id", "__key")
    kept = kept.toDF(*on)
    values = (F.col("doc_id").isNull(), F.coalesce(F.col("doc_id").cast("long"), F.lit(0)), F.xxhash64(F.coalesce("text", F.lit(""))))
    keyed = docs.withColumns(dict(zip(on, values, strict=True)))
    return keyed.join(kept, on, "left_semi").dropDuplicates(on).drop(*on)
