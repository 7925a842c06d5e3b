"""Saved builds: identity, size, retention; recent queries and files."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.vocabulary import MOST_BUILDS, MOST_BYTES, MOST_FILES, MOST_QUERIES, MOST_VERSIONS

FNV_START, FNV_PRIME = 2166136261, 16777619


def _fnv(text, start):
    """FNV-1a over the code points of a text (ASCII ids), 32 bits, going on from ``start``."""
    step = lambda h, c: (h.bitwiseXOR(F.ascii(c).cast("long")) * FNV_PRIME) % (1 << 32)
    return F.aggregate(F.filter(F.split(text, ""), lambda c: c != ""), start, step)


def signature_v1(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Version of a small build: FNV-1a over its sorted ids and the number of its edges, in base 36. All ids of a corpus
    meet in one row, so this is for builds of a few hundred thousand entities, whose saved versions it must match;
    ``signature_v2`` is for any size."""
    ids = nodes.groupBy("corpus").agg(F.array_join(F.sort_array(F.collect_list("id")), "").alias("ids"))
    counts = edges.groupBy("corpus").agg(F.count("*").alias("n"))
    joined = ids.join(counts, "corpus", "left")
    text = F.concat("ids", F.lit("|"), F.coalesce("n", F.lit(0)).cast("string"))
    digest = _fnv(text, F.lit(FNV_START).cast("long"))
    return joined.select("corpus", F.lower(F.conv(digest.cast("string"), 10, 36)).alias("version"))


def signature_v2(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """A version that edges change too, whatever the order of rows: sums of hashes, so builds of any size do."""
    hashed = lambda *cols: F.conv(F.substring(F.md5(F.concat_ws("|", *cols)), 1, 15), 16, 10).cast("decimal(38,0)")
    parts = nodes.select("corpus", hashed("id").alias("nodes"), F.lit(1).alias("n"), F.lit(0).cast("decimal(38,0)").alias("edges"), F.lit(0).alias("e"))
    parts = parts.unionByName(edges.select("corpus", F.lit(0).cast("decimal(38,0)").alias("nodes"), F.lit(0).alias("n"), hashed("s", "t", "rel", "conf").alias("edges"), F.lit(1).alias("e")))
    summed = parts.groupBy("corpus").agg(*[F.sum(c).cast("string").alias(c) for c in ("nodes", "n", "edges", "e")])
    return summed.select("corpus", F.substring(F.md5(F.concat_ws(":", "nodes", "n", "edges", "e")), 1, 12).alias("version"))


def build_size(sources: DataFrame, nodes: DataFrame, edges: DataFrame, passages: DataFrame) -> DataFrame:
    """Estimated bytes of each corpus: its sources, and a flat price for each node, edge and passage."""
    parts = [
        sources.select("corpus", (F.length("path") + F.length("src")).cast("long").alias("bytes")),
        nodes.select("corpus", F.lit(180).cast("long").alias("bytes")),
        edges.select("corpus", F.lit(90).cast("long").alias("bytes")),
        passages.select("corpus", F.lit(400).cast("long").alias("bytes")),
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out.groupBy("corpus").agg(F.sum("bytes").alias("bytes"))


def eviction(builds: DataFrame) -> DataFrame:
    """Which saved builds(id, name, saved_at, bytes) go: beyond MOST_VERSIONS of a name, beyond MOST_BUILDS, or past
    MOST_BYTES of all newer ones together, doomed ones included. Order: newest first, then id.

    Builds beyond the newest MOST_BUILDS go whatever their size, so running totals need only those few; the count of
    newer ones is exact without a window over all builds.
    """
    top = builds.orderBy(F.desc("saved_at"), F.desc("id")).limit(MOST_BUILDS)
    w = Window.orderBy(F.desc("saved_at"), F.desc("id"))
    running = top.select("id", F.sum("bytes").over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("running"))
    version = F.row_number().over(Window.partitionBy("name").orderBy(F.desc("saved_at"), F.desc("id")))
    out = builds.withColumn("version_no", version).join(F.broadcast(running), "id", "left")
    doomed = (F.col("version_no") > MOST_VERSIONS) | F.col("running").isNull() | (F.col("running") > MOST_BYTES)
    return out.select("id", "name", "saved_at", "bytes", "version_no", doomed.alias("doomed"))


def upsert(builds: DataFrame, new: DataFrame) -> DataFrame:
    """The latest row of every id."""
    both = builds.unionByName(new)
    rest = [c for c in both.columns if c != "id"]
    return both.groupBy("id").agg(F.max_by(F.struct(*rest), "saved_at").alias("row")).select("id", "row.*").select(*both.columns)


def without(builds: DataFrame, gone: DataFrame | None = None) -> DataFrame:
    """The builds whose id is not among gone(id), of which nulls and unknown ids do nothing; none at all without ``gone``."""
    return builds.limit(0) if gone is None else builds.join(gone.select("id"), "id", "left_anti").select(*builds.columns)


def versions_by_name(builds: DataFrame) -> DataFrame:
    return builds.groupBy("name").agg(F.count("*").alias("versions"), F.sum("bytes").alias("bytes"), F.max("saved_at").alias("latest"))


def recent_queries(log: DataFrame, n: int = MOST_QUERIES) -> DataFrame:
    """The last distinct queries of each corpus from log(corpus, query, stamp); trimmed, of two characters at least."""
    said = log.select("corpus", F.trim("query").alias("query"), "stamp").where(F.length("query") >= 2)
    last = said.groupBy("corpus", "query").agg(F.max("stamp").alias("stamp"))
    rank = F.row_number().over(Window.partitionBy("corpus").orderBy(F.desc("stamp"), "query"))
    return last.withColumn("rank", rank).where(F.col("rank") <= n)


def recent_files(log: DataFrame, existing: DataFrame | None = None, n: int = MOST_FILES) -> DataFrame:
    """The last distinct files of each corpus from log(corpus, path, line, stamp), each with its latest line; with
    ``existing``(corpus, path) only those that are still there."""
    last = log.where("path is not null").groupBy("corpus", "path").agg(F.max_by("line", "stamp").alias("line"), F.max("stamp").alias("stamp"))
    rank = F.row_number().over(Window.partitionBy("corpus").orderBy(F.desc("stamp"), "path"))
    out = last.withColumn("rank", rank).where(F.col("rank") <= n)
    return out if existing is None else out.join(existing, ["corpus", "path"], "left_semi")
