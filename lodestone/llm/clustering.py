"""Exact k-means over integer vectors, by exponion search.

Every vector carries an upper bound on the distance to its centroid and a lower bound on that to any other. While the first
stays below the second, or below half the way to the nearest other centroid, nothing is computed for it. Otherwise only
centroids inside a ball around its current centroid are scanned, along that centroid's sorted list of distances to the
others. A round is one pass of Spark over the vectors; what it gathers is a sum for each cluster and task.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize

K, ROUNDS, SEED, COMPONENTS, SCALE = 40, 5, "2", 64, 256
#: Components beyond this are taken as this: squared distances past it would not fit in a long.
LARGEST = (1 << 31) - 1
#: Bounds are floats: each is widened by this share, so that rounding never prunes a centroid. Distances are compared as whole numbers.
SLACK = 1e-9
LONG = (1 << 63) - 1

SCHEMA = "vec_id long, v binary, cluster int, upper double, lower double, distance long, n long, sums array<long>, scanned long"
_NAMES = [c.split()[0] for c in SCHEMA.split(", ")]
_TYPES = [pa.int64(), pa.binary(), pa.int32(), pa.float64(), pa.float64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.int64()]


def _whole(batches, components: int):
    """The rows whose vectors are kept, as whole numbers of four bytes."""
    for batch in batches:
        lists = batch.column("embedding").cast(pa.large_list(pa.float64()))
        lengths = np.asarray(lists.value_lengths().fill_null(0))
        flat = lists.flatten()
        values, valid = flat.fill_null(np.nan).to_numpy(zero_copy_only=False), lengths == components
        ends = np.cumsum(lengths)
        places = (ends[valid] - components)[:, None] + np.arange(components)
        vectors = values[places].reshape(-1, components)
        finite = np.isfinite(vectors).all(axis=1)
        whole = np.clip(np.floor(vectors[finite] * SCALE), -LARGEST, LARGEST).astype("<i4")
        ids = batch.column("vec_id").filter(pa.array(valid)).filter(pa.array(finite))
        yield pa.RecordBatch.from_arrays([ids, pa.array([row.tobytes() for row in whole], pa.binary())], ["vec_id", "v"])


def whole_vectors(embeddings: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """vec_id and v, the components' floor(256 * x) as little-endian integers of four bytes, of the rows whose embedding has
    exactly ``components`` components, none of them null, NaN or infinite. Repeated rows and ids stay, null ids too."""
    rows = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    return rows.mapInArrow(lambda batches: _whole(batches, components), "vec_id long, v binary")


def squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances of all rows of ``a`` to all of ``b``. Both hold whole numbers, as floats small enough to be exact
    or as Python's integers."""
    return (a * a).sum(axis=1)[:, None] - 2 * (a @ b.T) + (b * b).sum(axis=1)


def _exactly(*arrays: np.ndarray) -> list[np.ndarray]:
    """The arrays as floats if squared distances between their rows are exact so, or else as Python's integers."""
    largest = max((int(np.abs(a.astype(np.int64)).max()) for a in arrays if a.size), default=0)
    kind = np.float64 if arrays[0].shape[1] * (2 * largest) ** 2 < 1 << 52 else object
    return [a.astype(np.int64).astype(kind) for a in arrays]


class Search:
    """The centroids of a round, with the others of each in order of distance, and how far each has moved."""

    def __init__(self, centroids: np.ndarray, before: np.ndarray | None):
        self.centroids = centroids
        k = len(centroids)
        exact = _exactly(centroids, centroids)
        between = np.sqrt(squared(*exact).astype(np.float64))
        np.fill_diagonal(between, -1)
        self.order = np.argsort(between, axis=1, kind="stable")[:, 1:]
        self.sorted = np.take_along_axis(between, self.order, axis=1)
        self.nearest = self.sorted[:, 0] if k > 1 else np.full(k, np.inf)
        if before is not None:
            old, new = _exactly(before, centroids)
            moved = np.sqrt(((old - new) ** 2).sum(axis=1).astype(np.float64)) * (1 + SLACK)
            # The lower bound falls by the most that any other centroid has moved.
            top = np.argsort(moved)[::-1]
            self.moved, self.others = moved, np.full(k, moved[top[0]])
            self.others[top[0]] = moved[top[1]] if k > 1 else 0

    def scan(self, vectors: np.ndarray):
        """Every vector against every centroid: cluster, squared distance, bounds, distances computed."""
        v, c = _exactly(vectors, self.centroids)
        d = squared(v, c)
        cluster = d.argmin(axis=1)  # the first of equals: the smaller number
        rows = np.arange(len(v))
        best = d[rows, cluster].copy()
        if len(c) > 1:
            d[rows, cluster] = max(d.max() + 1, 0) if d.dtype == object else np.inf
            second = np.sqrt(d.min(axis=1).astype(np.float64))
        else:
            second = np.full(len(v), np.inf)
        return cluster, best, np.sqrt(best.astype(np.float64)), second, d.size

    def move(self, vectors: np.ndarray, cluster: np.ndarray, upper: np.ndarray, lower: np.ndarray, closing: bool):
        """The same by bounds from the round before. ``closing`` asks for the distances of all vectors."""
        v, c = _exactly(vectors, self.centroids)
        upper = (upper + self.moved[cluster]) * (1 + SLACK)
        lower = lower - self.others[cluster] - SLACK * (lower + self.others[cluster])
        cluster, best = cluster.copy(), np.zeros(len(v), dtype=v.dtype)
        safe = np.maximum(lower, self.nearest[cluster] / 2 * (1 - SLACK))
        near = np.flatnonzero(upper >= safe)  # equal bounds may hide a tie
        rows = np.arange(len(v)) if closing else near
        best[rows] = ((v[rows] - c[cluster[rows]]) ** 2).sum(axis=1)
        upper[rows] = np.sqrt(best[rows].astype(np.float64)) * (1 + SLACK)
        scanned = len(rows)
        near = near[upper[near] >= safe[near]]
        for a in np.unique(cluster[near]):
            group = near[cluster[near] == a]
            # Inclusive: a centroid on the ball's edge may be as near as the current one.
            within = np.searchsorted(self.sorted[a], (2 * upper[group] + self.nearest[a]) * (1 + SLACK), side="right")
            group, within = group[np.argsort(-within, kind="stable")], np.sort(within)[::-1]
            first, second, arg = best[group], np.full(len(group), np.inf, dtype=v.dtype), np.full(len(group), a)
            for rank in range(within[0]):
                j, n = self.order[a][rank], int(np.searchsorted(-within, -rank, side="left"))
                d = ((v[group[:n]] - c[j]) ** 2).sum(axis=1)
                scanned += n
                wins = (d < first[:n]) | ((d == first[:n]) & (j < arg[:n]))
                second[:n] = np.minimum(second[:n], np.where(wins, first[:n], d))
                first[:n], arg[:n] = np.where(wins, d, first[:n]), np.where(wins, j, arg[:n])
            cluster[group], best[group] = arg, first
            upper[group] = np.sqrt(first.astype(np.float64)) * (1 + SLACK)
            lower[group] = np.sqrt(second.astype(np.float64)) * (1 - SLACK)
        return cluster, best, upper, lower, scanned


def _round(batches, search: Search, first: bool, closing: bool):
    k, d = search.centroids.shape
    sums, sizes, scanned = np.zeros((k, d), dtype=object), np.zeros(k, dtype=np.int64), 0
    for batch in batches:
        n = len(batch)
        vectors = np.frombuffer(b"".join(batch.column("v").to_pylist()), dtype="<i4").reshape(n, d)
        if first:
            cluster, best, upper, lower, more = search.scan(vectors)
        else:
            bounds = [batch.column(c).to_numpy(zero_copy_only=False) for c in ("cluster", "upper", "lower")]
            cluster, best, upper, lower, more = search.move(vectors, bounds[0].astype(np.int64), *bounds[1:], closing)
        scanned += more
        for a in np.unique(cluster):
            rows = cluster == a
            sums[a] += vectors[rows].sum(axis=0, dtype=np.int64)
            sizes[a] += rows.sum()
        columns = [
            batch.column("vec_id"), batch.column("v") if not closing else pa.nulls(n, pa.binary()), pa.array(cluster, pa.int32()),
            pa.array(upper, pa.float64()), pa.array(lower, pa.float64()),
            pa.array([min(int(x), LONG) for x in best], pa.int64()) if closing else pa.nulls(n, pa.int64()), *(pa.nulls(n, t) for t in _TYPES[6:]),
        ]
        yield pa.RecordBatch.from_arrays(columns, _NAMES)
    used = np.flatnonzero(sizes).tolist()
    if used:
        nulls = [pa.nulls(len(used), t) for t in _TYPES]
        nulls[2], nulls[6] = pa.array(used, pa.int32()), pa.array(sizes[used], pa.int64())
        nulls[7] = pa.array([list(map(int, sums[a])) for a in used], pa.list_(pa.int64()))
        nulls[8] = pa.array([scanned, *[0] * (len(used) - 1)], pa.int64())
        yield pa.RecordBatch.from_arrays(nulls, _NAMES)


def _means(state: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """The centroids after a round: floors of exact means, from k x d sums; empty clusters keep theirs."""
    parts = state.where(F.col("n").isNotNull())
    sizes = parts.groupBy("cluster").agg(F.sum("n").alias("n"))
    sums = parts.select("cluster", F.posexplode("sums").alias("at", "x")).groupBy("cluster", "at").agg(F.sum(F.col("x").cast("decimal(38,0)")).alias("x"))
    out = centroids.copy()
    for row in sums.join(F.broadcast(sizes), "cluster").collect():  # k x d rows
        out[row["cluster"], row["at"]] = int(row["x"]) // row["n"]
    return out


class Clusters:
    """``vectors``: vec_id, cluster, distance (squared) of every vector; ``centroids``: the last ones; ``scanned``: distances
    between vectors and centroids that each pass has computed."""

    def __init__(self, vectors: DataFrame, centroids: np.ndarray, scanned: list[int]):
        self.vectors, self.centroids, self.scanned = vectors, centroids, scanned


def kmeans(embeddings: DataFrame, k: int = K, rounds: int = ROUNDS, seed: str = SEED, components: int = COMPONENTS) -> Clusters:
    """``rounds`` rounds of assignment and update, and one last assignment, as exact as whole numbers are.

    Centroids start as the kept vectors with the k smallest SHA-256 of ``seed:vec_id``, null ids last and equal ones (rows
    that repeat or share an id) by their components; fewer vectors give fewer centroids. Among equally near centroids the
    smaller number wins. Each pass reads the vectors with their bounds and writes them anew to the shared folder, where the
    pass before is deleted then. An empty table, or one without a kept vector, gives no centroids and no rows. Further
    columns are ignored. Components beyond ``LARGEST`` are taken as that, and distances beyond a long as the largest long.
    """
    vectors = materialize(whole_vectors(embeddings, components), "vectors")
    name = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    start = vectors.orderBy(name.asc_nulls_last(), F.hex("v")).limit(k).collect()
    centroids = np.array([np.frombuffer(r["v"], dtype="<i4") for r in start], dtype=np.int64).reshape(len(start), components)
    if not start:
        return Clusters(vectors.select("vec_id", F.lit(0).alias("cluster"), F.lit(0).cast("long").alias("distance")), centroids, [])
    state, before, scanned = vectors, None, []
    for turn in range(rounds + 1):
        search, first, closing = Search(centroids, before), not turn, turn == rounds
        found = state.where(F.col("v").isNotNull())
        new = materialize(found.mapInArrow(lambda batches, s=search, f=first, c=closing: _round(batches, s, f, c), SCHEMA), "clusters")
        discard(state)
        state = new
        scanned.append(state.agg(F.sum("scanned")).first()[0])
        if not closing:
            before, centroids = centroids, _means(state, centroids)
    return Clusters(state.where(F.col("n").isNull()).select("vec_id", "cluster", "distance"), centroids, scanned)


def cluster(embeddings: DataFrame, **options) -> DataFrame:
    """Per kept vector: vec_id, cluster, distance, cluster_inertia and inertia (its sums over the cluster and over all),
    centroid_sha256 (of its centroid's components in decimal, joined by commas). Options and edge cases: ``kmeans``."""
    found = kmeans(embeddings, **options)
    digests = [(j, hashlib.sha256(",".join(map(str, row.tolist())).encode()).hexdigest()) for j, row in enumerate(found.centroids)]
    digests = embeddings.sparkSession.createDataFrame(digests, "cluster int, centroid_sha256 string")
    total = lambda x: F.least(F.sum(x.cast("decimal(38,0)")), F.lit(LONG).cast("decimal(38,0)"))
    sums = found.vectors.groupBy("cluster").agg(total(F.col("distance")).alias("own"))
    whole = sums.agg(total(F.col("own")).cast("long").alias("inertia"))
    facts = sums.join(digests, "cluster").crossJoin(F.broadcast(whole))  # one row beside k
    facts = facts.select("cluster", F.col("own").cast("long").alias("cluster_inertia"), "inertia", "centroid_sha256")
    return found.vectors.join(F.broadcast(facts), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
