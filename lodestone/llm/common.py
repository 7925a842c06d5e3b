"""Helpers shared by the corpus operators."""

from __future__ import annotations

import atexit
import gc
import shutil
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share. Where the session names none, a local master gets a fresh temporary one (tests);
    on a cluster, whose executors would each write to a disk of their own, that is an error."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="lodestone-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: cuts lineage, and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(*tables: DataFrame) -> None:
    """Delete the files of tables that ``materialize`` wrote and that no further plan reads."""
    for df in tables:
        spark = df.sparkSession
        for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            path = spark._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def release(spark: SparkSession) -> None:
    """Have Spark drop the shuffle files of plans that nothing refers to any more. It does so when the driver collects
    its garbage, which may be long after the next shuffle has been written beside them. Spark's listeners hold on to
    the query that ended last, so a query of one row ends first."""
    gc.collect()
    spark.range(1).count()
    spark.sparkContext._jvm.System.gc()


def documents_of(docs: DataFrame, *extra: str) -> DataFrame:
    """doc_id (long) and whole text (null: empty), with the named further columns (null where absent)."""
    cols = [F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text")]
    cols += [(F.col(c) if c in docs.columns else F.lit(None)).cast("string").alias(c) for c in extra]
    return docs.select(*cols)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """``names``, changed where ``df`` has such columns already."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def join_hot(rows: DataFrame, facts: DataFrame, on: str, size: str, share: int = 1000) -> DataFrame:
    """``rows`` joined with ``facts``, which has each value of ``on`` once and says in ``size`` how many rows hold it.

    Values with more than one in ``share`` of all rows, fewer than ``share`` of them, are broadcast, so the rows of a
    very common value stay where they are; the others are shuffled. ``facts`` and ``rows`` are read more than once.
    """
    total = facts.agg(F.sum(size)).first()[0] or 0
    hot = facts.where(F.col(size) > total // share)
    there = rows.join(F.broadcast(hot.drop(size)), on)
    rest = rows.join(F.broadcast(hot.select(on)), on, "left_anti")
    return there.unionByName(rest.join(facts.where(F.col(size) <= total // share).drop(size), on))


def utf8_buffer(column: pa.ChunkedArray | pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column end to end, and the n + 1 offsets of its rows in them."""
    column = column.cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    data = np.frombuffer(data, dtype=np.uint8) if data is not None else np.empty(0, dtype=np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(batches, rows: int = 2000, size: int = 8 << 20):
    """Arrow batches cut to at most ``rows`` rows and, where single rows allow it, ``size`` text bytes."""
    for batch in batches:
        lengths = batch.column("text").cast(pa.large_string())
        ends = np.frombuffer(lengths.buffers()[1], dtype=np.int64)[lengths.offset : lengths.offset + len(batch) + 1]
        start = 0
        while start < len(batch):
            stop = int(np.searchsorted(ends, ends[start] + size, "right")) - 1
            stop = min(max(stop, start + 1), start + rows, len(batch))
            yield batch.slice(start, stop - start)
            start = stop


def connected_components(edges: DataFrame, label: str = "components") -> DataFrame:
    """Connected components of ``edges(u, v)`` (long): rows (node, component), component its smallest node.

    Large-star and small-star steps alternate until nothing changes: rounds grow with the logarithm of the
    longest path. Each round groups by node with map-side minima, so a node with very many neighbours is no
    hot task, and is written to the shared folder. Self-loops and repeated edges do no harm.
    """
    pairs = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct()
    pairs = materialize(pairs, label)
    seen = None
    while True:
        both = pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u")
        small = small.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(
            least.select("u", F.col("m").alias("v"))
        )
        before, pairs = pairs, materialize(small.where("u <> v").distinct(), label)
        discard(before)
        now = pairs.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.bit_xor(F.xxhash64("v", "u"))).first()
        if now == seen:
            break
        seen = now
    return pairs.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        pairs.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )
