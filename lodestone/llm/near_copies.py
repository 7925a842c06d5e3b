"""Groups of texts whose word shingles agree by a Jaccard similarity of at least 4/5: tries of SimHash fingerprints give the
candidates, whole sets verify them, and an exact prefix-filter join finds the links that all tries miss."""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import bitmap, simhash
from .common import connected_components, discard, documents_of, fresh, materialize, release, slices

SHINGLE = 5
SEED = 42
#: Shingles that recur in a sample of the classes come last in the order of prefixes. This saves work and never decides a
#: result, as any order common to all sets finds all pairs: so a sample and a bound on what is broadcast do no harm.
SAMPLE, RECURS, MOST_RECURRING = 4, 5, 1 << 18
#: Candidate pairs a posting that are taken at once; beyond, groups are first thinned by comparing with HUBS members of
#: each, as long as a round at least halves the candidates.
DENSE, HUBS = 4, 4
#: 64-bit words of a set's sketch: of each bit, whether an odd number of the set's hashes falls on it.
SKETCH = 8
#: Fingerprints of a set, each in a trie of its own, their bits, and the bits by which those of candidates differ at most. Sets alike
#: by 4/5 differ in 0.15 of the bits, so they are within the budget of one of the tries at least with a chance of 0.86.
TREES, TREE_BITS, BUDGET = 32, 28, 1
#: Bits beyond the logarithm of the rows: the leaves near a leaf by chance are then as many however many rows there are. With bits that are fixed
#: they would grow with the rows, and all pairs of them with the square.
SPARE_BITS, MOST_BITS = 10, 58
#: Bits of a trie's number in its keys, and the tries that are joined at once.
ROOT, AT_ONCE = 6, 16
_ODD = np.random.default_rng(SEED).integers(0, 1 << 63, TREES * MOST_BITS // 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_MIX = np.uint64(0x9E3779B97F4A7C15)


def shingles(text: bytes) -> np.ndarray:
    """The distinct XXH64 of the word shingles, ascending; a text of fewer words is one shingle, none without a word."""
    words = text.lower().split()
    if not words:
        return np.empty(0, dtype=np.uint64)
    k, digest = min(SHINGLE, len(words)), xxhash.xxh64_intdigest
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1) - 1
    starts = [0, *(ends[: len(words) - k] + 1).tolist()]
    found = [digest(joined[a:b], SEED) for a, b in zip(starts, ends[k - 1 :].tolist(), strict=True)]
    return np.unique(np.array(found, dtype=np.uint64))


def sketch(hashes: np.ndarray) -> np.ndarray:
    """Parities of the hashes by their low bits. Where two sets differ in d hashes, their sketches differ in d bits at most."""
    odd = np.bincount((hashes & np.uint64(64 * SKETCH - 1)).astype(np.int64), minlength=64 * SKETCH) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def tree_bits(rows: int) -> int:
    """Bits of a fingerprint among so many rows, even so that those of all tries fill whole words."""
    bits = max(rows, 1).bit_length() + SPARE_BITS
    return min(bits + bits % 2, MOST_BITS)


def fingerprints(hashes: np.ndarray, bits: int = TREE_BITS) -> np.ndarray:
    """SimHash fingerprints of a set, TREES of so many bits: the majority bits of its hashes, mixed anew for every 64 of them."""
    ones, odd = np.zeros(TREES * bits, dtype=np.int64), _ODD[: TREES * bits // 64]
    for at in range(0, len(hashes), 255):  # as many as a byte counts
        x = hashes[at : at + 255, None] * odd
        x ^= x >> np.uint64(29)
        x *= _MIX
        x ^= x >> np.uint64(32)
        ones += np.add.reduce(np.unpackbits(x.view(np.uint8), axis=1), axis=0, dtype=np.uint8)
    return (2 * ones > len(hashes)).reshape(TREES, bits) @ (1 << np.arange(bits))


def _lists(values: list[np.ndarray], dtype=np.int64) -> pa.ListArray:
    offsets = np.concatenate([[0], np.cumsum([len(v) for v in values])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([*values, np.empty(0, dtype=dtype)]).astype(dtype)))


def _classes(bits: int):
    """The rows with the class of their set, its size, sketch and fingerprints in place of the text."""

    def run(batches):
        for batch in slices(batches):
            found = [shingles(text.encode()) for text in batch.column("text").to_pylist()]
            classes = pa.array(np.array([xxhash.xxh64_intdigest(s.tobytes(), SEED) for s in found], dtype=np.uint64).view(np.int64))
            columns = [batch.column(c) for c in ("doc_id", "key", "at")]
            sizes = pa.array([len(s) for s in found], pa.int32())
            made = [sizes, _lists([sketch(s) for s in found]), _lists([fingerprints(s, bits) for s in found], np.int32 if bits < 32 else np.int64)]
            yield pa.RecordBatch.from_arrays([*columns, classes, *made], ["doc_id", "key", "at", "cls", "size", "s", "t"])

    return run


def _sets(filled):
    """at, class and set of the rows whose ``at`` is in a bitmap: sets are larger than their texts, so they are made anew where
    they are needed and never written for all."""

    def run(batches):
        for batch in slices(batches):
            at = np.asarray(batch.column("at").to_numpy(zero_copy_only=False), dtype=np.int64)
            batch = batch.filter(pa.array(bitmap.has(filled.value, at.view(np.uint64))))
            found = [shingles(text.encode()) for text in batch.column("text").to_pylist()]
            classes = pa.array(np.array([xxhash.xxh64_intdigest(s.tobytes(), SEED) for s in found], dtype=np.uint64).view(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column("at"), classes, _lists([s.view(np.int64) for s in found])], ["at", "cls", "hs"])

    return run


def _prefixes(recurring: np.ndarray, ranks: np.ndarray):
    """Of each set, by rising rank and hash, the postings that the first common shingle of a close pair can be at."""

    def run(batches):
        for batch in batches:
            out = [[], [], [], []]
            for cls, found in zip(batch.column("cls").to_pylist(), batch.column("hs"), strict=True):
                hs = found.values.to_numpy(zero_copy_only=False)
                n = len(hs)
                if len(recurring):
                    at = np.minimum(np.searchsorted(recurring, hs), len(recurring) - 1)
                    hs = hs[np.lexsort((hs, np.where(recurring[at] == hs, ranks[at], 0)))]
                stop = n - (4 * n + 4) // 5 + 1 if n else 0
                for column, v in zip(out, (hs[:stop], np.full(stop, cls), np.full(stop, n), np.arange(stop)), strict=True):
                    column.append(v)
            arrays = [pa.array(np.concatenate([*v, np.empty(0, dtype=np.int64)]).astype(t)) for v, t in zip(out, ("i8", "i8", "i4", "i4"), strict=True)]
            yield pa.RecordBatch.from_arrays(arrays, ["h", "cls", "n", "i"])

    return run


def _postings(texts: DataFrame, about: DataFrame) -> DataFrame:
    """h, cls, n (size of the set) and i (place of h in its order) of the prefixes, where two classes or more share h. One row
    of each class is read."""
    spark = texts.sparkSession
    filled = spark.sparkContext.broadcast(bitmap.collect(about, "at"))
    # Whole sets, not their prefixes: what is moved back makes room for the next shingle, which may recur as well.
    some = texts.where(F.pmod("at", F.lit(SAMPLE)) == 0).mapInArrow(_sets(filled), "at long, cls long, hs array<long>")
    seen = some.select(F.explode("hs").alias("h")).groupBy("h").count().where(F.col("count") >= RECURS)
    seen = seen.orderBy(F.desc("count"), "h").limit(MOST_RECURRING).toArrow()
    hs, ranks = (seen.column(c).to_numpy().astype(np.int64) for c in ("h", "count"))
    order = np.argsort(hs)
    sets, cut = _sets(filled), _prefixes(hs[order], ranks[order])
    posts = texts.mapInArrow(lambda batches: cut(sets(batches)), "h long, cls long, n int, i int").repartition("h").dropDuplicates(["h", "cls"])
    posts = posts.withColumn("m", F.count("*").over(Window.partitionBy("h"))).where("m > 1").drop("m")
    return materialize(posts, "near-copies-postings")


def _verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """Those of pairs(u, v) of classes, of which rows u_at and v_at are members, whose whole sets are close."""
    ends = pairs.select(F.col("u_at").alias("at")).unionByName(pairs.select(F.col("v_at").alias("at"))).distinct()
    filled = texts.sparkSession.sparkContext.broadcast(bitmap.collect(ends, "at"))
    held = texts.mapInArrow(_sets(filled), "at long, cls long, hs array<long>").join(ends, "at", "left_semi").dropDuplicates(["at", "cls"])
    held = materialize(held, "near-copies-held")
    side = lambda end, name: held.select(F.col("at").alias(f"{end}_at"), F.col("cls").alias(end), F.col("hs").alias(name))
    both = pairs.join(side("u", "x"), ["u_at", "u"]).join(side("v", "y"), ["v_at", "v"])
    common = F.size(F.array_intersect("x", "y"))
    links = materialize(both.where(9 * common >= 4 * (F.size("x") + F.size("y"))).select("u", "v"), "near-copies-links")
    discard(held)
    filled.destroy()
    return links


_APART = " + ".join(f"bit_count(a.s[{k}] ^ b.s[{k}])" for k in range(SKETCH))


def _candidates(prints: DataFrame, bits: int = TREE_BITS) -> DataFrame:
    """Pairs (u, v, u_at, v_at) of the classes in prints(cls, at, t) that a trie of their fingerprints of so many bits brings together.

    The tries are joined with themselves within BUDGET. A leaf has one class that stands for it, another one by chance in each
    trie: it meets those of the leaves nearby and the others of its leaf, so crowded leaves are never expanded to pairs.
    """
    out = []
    for first in range(0, TREES, AT_ONCE):
        some = prints.select(F.struct("cls", "at").alias("one"), F.posexplode(F.slice("t", first + 1, AT_ONCE)).alias("tree", "path"))
        fp = F.expr(f"shiftleft(cast(tree as bigint), {64 - ROOT}) | shiftleft(cast(path as bigint), {64 - ROOT - bits})")
        some = some.select("one", fp.alias("fp"))
        heads = some.groupBy("fp").agg(F.min_by("one", F.xxhash64("one.cls", "fp")).alias("head"), F.count("*").alias("n"))
        heads = materialize(heads, "near-copies-leaves")
        near = simhash.close_pairs(heads.select("fp"), BUDGET, ROOT, bits)
        key = F.shiftrightunsigned("fp", 64 - ROOT - bits)
        side = lambda end, name: heads.select(key.alias(end), F.col("head").alias(name))  # noqa: B023, E731
        across = near.join(side("a", "x"), "a").join(side("b", "y"), "b").select("x", "y")
        within = some.join(heads.where("n > 1"), "fp").select(F.col("one").alias("x"), F.col("head").alias("y"))
        both = across.unionByName(within).where("x.cls <> y.cls")
        both = both.select(F.least("x", "y").alias("u"), F.greatest("x", "y").alias("v")).distinct()
        both = both.select(F.col("u.cls").alias("u"), F.col("v.cls").alias("v"), F.col("u.at").alias("u_at"), F.col("v.at").alias("v_at"))
        out.append(materialize(both, "near-copies-met"))
        discard(near, heads)
        release(prints.sparkSession)
    met = materialize(functools.reduce(DataFrame.unionByName, out).distinct(), "near-copies-met")
    discard(*out)
    return met


def _trie_parts(texts: DataFrame, about: DataFrame, prints: DataFrame, bits: int) -> DataFrame:
    """(node, component) of the classes that the tries' candidates link: those of close sketches first, then of close sets."""
    met = _candidates(prints, bits)
    side = lambda end: about.select(F.col("cls").alias(end), F.struct("size", "s").alias({"u": "a", "v": "b"}[end]))
    near = met.join(side("u"), "u").join(side("v"), "v")
    near = near.where(f"9 * least(a.size, b.size) >= 4 * (a.size + b.size) and 9 * ({_APART}) <= a.size + b.size")
    near = materialize(near.select("u", "v", "u_at", "v_at"), "near-copies-pairs")
    discard(met)
    links = _verified(near, texts)
    discard(near)
    parts = materialize(connected_components(links, "near-copies-components"), "near-copies-members")
    discard(links)
    release(texts.sparkSession)
    return parts


def _members(texts: DataFrame, about: DataFrame, prints: DataFrame, bits: int) -> DataFrame:
    """(node, component) of the classes in ``about``, made of ``texts``, that are close to another one.

    The tries' candidates come first. The links they miss are found exactly: the first common shingle of two close sets, at i
    of n and j of m, leaves at least 4/9 (n + m) in both, so they meet in their prefixes. Close sets differ in at most (n + m) / 9
    shingles, and so do their sketches in bits: the join on a shingle lets only such pairs through. Where a shingle has many
    classes, each is compared with HUBS of them, half of them those where it stands first, so with the fewest shingles of their
    own and nearest to what the group has in common, and the others by chance, new ones in each round; only pairs that no
    component holds yet are left, and all of those are compared in the end. Postings of one component alone meet nobody.
    """
    parts, before, turn = _trie_parts(texts, about, prints, bits), None, 0
    posts = _postings(texts, about)
    n_posts = posts.count()
    release(posts.sparkSession)
    near = F.expr(f"a.h = b.h and a.part <> b.part and 9 * least(a.n - a.i, b.n - b.i) >= 4 * (a.n + b.n) and 9 * ({_APART}) <= a.n + b.n")
    while n_posts:
        of = about.select("cls", "at", "s").join(parts.withColumnRenamed("node", "cls"), "cls", "left").withColumn("part", F.coalesce("component", "cls")).drop("component")
        keyed = materialize(posts.join(of.select("cls", "part"), "cls"), "near-copies-keyed")
        mixed = keyed.groupBy("h").agg(F.min("part").alias("p"), F.max("part").alias("q")).where("p <> q").select("h")
        at = materialize(keyed.join(mixed, "h", "left_semi").join(of.select("cls", "at", "s"), "cls"), "near-copies-parts")
        discard(keyed)
        release(posts.sparkSession)
        size = at.groupBy("h", "part").count().groupBy("h").agg(F.sum("count").alias("m"), F.sum(F.col("count") * F.col("count")).alias("own"))
        open_pairs = size.agg(F.coalesce(F.sum((F.col("m") * F.col("m") - F.col("own")) / 2), F.lit(0.0))).first()[0]
        met = at.alias("a").join(at.alias("b"), near & F.expr("a.cls < b.cls"))
        if open_pairs > DENSE * n_posts and turn:
            open_pairs = met.count()
        last = open_pairs <= DENSE * n_posts or (before is not None and 2 * open_pairs > before)
        if not last:
            places = [F.col("i") if k < HUBS // 2 else F.lit(0) for k in range(HUBS)]
            orders = [(p.alias("place"), F.xxhash64("cls", F.lit(HUBS * turn + k)).alias("o")) for k, p in enumerate(places)]
            hubs = [F.min(F.struct(*order, "at", "n", "i")) for order in orders]
            hub = at.groupBy("h").agg(F.array(*hubs).alias("hubs")).select("h", F.explode("hubs").alias("hub"))
            hub = hub.select("h", "hub.at", "hub.n", "hub.i").join(of, "at")
            met = at.alias("b").join(hub.alias("a"), near)
        one, two = F.struct("a.cls", "a.at"), F.struct("b.cls", "b.at")
        pairs = met.select(F.least(one, two).alias("u"), F.greatest(one, two).alias("v")).distinct()
        pairs = materialize(pairs.select(F.col("u.cls").alias("u"), F.col("v.cls").alias("v"), F.col("u.at").alias("u_at"), F.col("v.at").alias("v_at")), "near-copies-pairs")
        discard(at)
        links = _verified(pairs, texts)
        discard(pairs)
        release(posts.sparkSession)
        # Members joined to their component stand for all links found so far.
        known = links.unionByName(parts.select(F.col("node").alias("u"), F.col("component").alias("v")))
        old, parts = parts, materialize(connected_components(known, "near-copies-components"), "near-copies-members")
        discard(links, old)
        if last:
            break
        before, turn = open_pairs if turn else None, turn + 1
    discard(posts)
    return parts


def representatives(docs: DataFrame) -> DataFrame:
    """One row of ``docs`` for each group of near copies: that of the smallest doc_id, nulls last; among rows of that id
    the text of least hash, and one of equal rows. All columns stay.

    Two texts are near copies if the sets of their shingles of five words (ASCII case and white space aside) have a
    Jaccard similarity of 4/5 at least; groups are the connected components. Texts without a word are one group.
    """
    keyed = documents_of(docs).select("doc_id", F.xxhash64("text").alias("key"), F.xxhash64(F.coalesce("doc_id", F.lit(-1)), "text").alias("at"), "text")
    texts = keyed.select("at", "text")
    bits = tree_bits(docs.count())
    schema = f"doc_id long, key long, at long, cls long, size int, s array<long>, t array<{'int' if bits < 32 else 'long'}>"
    sets = materialize(keyed.mapInArrow(_classes(bits), schema), "near-copies")
    order = F.struct(F.col("doc_id").isNull().alias("none"), F.coalesce("doc_id", F.lit(0)).alias("id"), "key")
    kept = materialize(sets.groupBy("cls").agg(F.min(order).alias("row"), F.min("at").alias("at")), "near-copies-classes")
    own = sets.join(kept.select("cls", "at"), ["cls", "at"], "left_semi").dropDuplicates(["cls"])
    about, prints = (materialize(own.select("cls", "at", *columns), "near-copies-classes") for columns in (("size", "s"), ("t",)))
    discard(sets)
    parts = _members(texts, about, prints, bits)
    discard(about, prints)
    kept = kept.join(parts.withColumnRenamed("node", "cls"), "cls", "left")
    kept = kept.groupBy(F.coalesce("component", "cls")).agg(F.min("row").alias("row"))
    kept = kept.select(F.col("row.none").alias("__none"), F.col("row.id").alias("__id"), F.col("row.key").alias("__key"))
    on = fresh(docs, "__none", "__id", "__key")
    kept = kept.toDF(*on)
    values = (F.col("doc_id").isNull(), F.coalesce(F.col("doc_id").cast("long"), F.lit(0)), F.xxhash64(F.coalesce("text", F.lit(""))))
    rows = docs.withColumns(dict(zip(on, values, strict=True)))
    return rows.join(kept, on, "left_semi").dropDuplicates(on).drop(*on)
