"""Source texts kept in the order of their paths: one text is found without a scan, and a search ends early.

A corpus is cut into parts of whole batches of files in path order, each a folder of its own, sorted and in small row groups.
A small table lists the parts with their first and last path. What reads the store looks there first, then opens the parts that it
needs and no others.
"""

from __future__ import annotations

import uuid
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.search import BATCH, MOST_MATCHES, line_matches
from ..plans.storage import materialize, running_sum, shared_dir

#: Files of a part, and bytes of a row group.
PART, GROUP = 50 * BATCH, 1 << 20


class Found(NamedTuple):
    """``matches``: corpus, path, line, col, context. ``truncated``: files were left when the limit was reached. ``files_read``: files
    of the parts that were opened."""

    matches: DataFrame
    files: int
    n_matches: int
    truncated: bool
    files_read: int


class Store:
    """Texts in ``folder``, whose parts ``index`` lists: corpus, part, first, last, n_files."""

    def __init__(self, spark: SparkSession, folder: str, index: DataFrame):
        self.spark, self.folder, self.index = spark, folder, index

    def parts(self, corpus: str, *numbers: int) -> DataFrame:
        """corpus, path, src and n (its place from 1) of some parts, which alone are opened."""
        paths = [f"{self.folder}/corpus={_escaped(corpus)}/part={k}" for k in numbers]
        return self.spark.read.schema("path string, src string, n long").parquet(*paths).withColumn("corpus", F.lit(corpus))

    def text(self, corpus: str, path: str) -> DataFrame:
        """(corpus, path, src) of one file, or no row. One part is opened, and in it the row groups that the path may be in."""
        found = self.index.where((F.col("corpus") == corpus) & (F.col("first") <= path) & (F.col("last") >= path)).select("part").collect()
        if not found:
            return self.spark.createDataFrame([], "corpus string, path string, src string")
        return self.parts(corpus, found[0]["part"]).where(F.col("path") == path).select("corpus", "path", "src")

    def texts(self, wanted: DataFrame) -> DataFrame:
        """(corpus, path, src) of many files, wanted(corpus, path): a join that prunes parts by those the paths fall in."""
        asked = wanted.select("corpus", "path").distinct()
        at = asked.join(F.broadcast(self.index), "corpus").where("path >= first AND path <= last").select("corpus", "part", "path")
        every = self.spark.read.option("basePath", self.folder).schema("path string, src string, n long, corpus string, part long").parquet(self.folder)
        return every.join(at, ["corpus", "part", "path"], "left_semi").select("corpus", "path", "src")

    def search(self, corpus: str, query: str, limit: int = MOST_MATCHES, batch: int = BATCH) -> Found:
        """``literal_search`` of one corpus that reads no further than it must.

        Parts are read in waves of 1, 2, 4, … of them in path order. A wave's matches are written and counted; once the
        batches before a part's end have ``limit`` matches, no later part is opened. So it reads less than twice the parts that hold
        the answer, and one more.
        """
        if batch <= 0 or PART % batch:
            raise ValueError("a part is a whole number of batches")
        sizes = {r["part"]: r["n_files"] for r in self.index.where(F.col("corpus") == corpus).select("part", "n_files").collect()}
        n_parts, start, width, total, files_read = len(sizes), 0, 1, 0, 0
        held: list[DataFrame] = []
        reached = False
        while start < n_parts and not reached:
            some = range(start, min(start + width, n_parts))
            texts = self.parts(corpus, *some)
            found = line_matches(texts.select("corpus", "path", "src", "n"), query).join(texts.select("path", "n"), "path")
            found = materialize(found.withColumn("batch", F.floor((F.col("n") - 1) / batch)), "search-wave")
            files_read += sum(sizes[k] for k in some)
            before = total
            total += found.count()
            reached = total >= limit
            held.append(found)
            start, width = some.stop, 2 * width
        matches = held[0] if held else None
        for more in held[1:]:
            matches = matches.unionByName(more)
        if matches is None:
            none = self.spark.createDataFrame([], "corpus string, path string, line int, col int, context string")
            return Found(none, 0, 0, False, 0)
        truncated = False
        if reached:
            # Only the last wave can hold the batch at which the limit is met: its batches with a match, in order, are few.
            for row in held[-1].groupBy("batch").count().orderBy("batch").toLocalIterator():
                before += row["count"]
                if before >= limit:
                    matches = matches.where(F.col("batch") <= row["batch"])
                    truncated = (row["batch"] + 1) * batch < sum(sizes.values())
                    break
        kept = matches.select("corpus", "path", "line", "col", "context")
        counted = kept.agg(F.count_distinct("path").alias("files"), F.count("*").alias("n")).first()
        return Found(kept, counted["files"], counted["n"], truncated, files_read)


def _escaped(name: str) -> str:
    """A value as it stands in the name of a partition's folder."""
    return "".join(f"%{ord(c):02X}" if c in "\"#%'*/:=?\\{[]^\x7f" or c < " " else c for c in name)


def store(files: DataFrame, folder: str | None = None) -> Store:
    """Write files(corpus, path, src) in order. Of a path that repeats in a corpus the longest text stays, of equally long ones that of
    least hash; null texts are empty, rows without a corpus or a path go. An empty table makes a store without parts."""
    spark = files.sparkSession
    folder = folder or f"{shared_dir(spark)}/stored-{uuid.uuid4().hex}"
    rows = files.where("corpus IS NOT NULL AND path IS NOT NULL").select("corpus", "path", F.coalesce("src", F.lit("")).alias("src"))
    rows = rows.groupBy("corpus", "path").agg(F.max_by("src", F.struct(F.length("src"), -F.xxhash64("src").cast("decimal(38,0)"))).alias("src"))
    rows = materialize(rows, "stored-once")
    places = running_sum(rows.select("corpus", "path", F.lit(1).cast("long").alias("one")), "corpus", ["path"], "one", "n").select("corpus", "path", "n")
    placed = rows.join(places, ["corpus", "path"]).withColumn("part", F.floor((F.col("n") - 1) / PART))
    index = placed.groupBy("corpus", "part").agg(F.min("path").alias("first"), F.max("path").alias("last"), F.count("*").alias("n_files"))
    index = materialize(index, "stored-index")
    # One task writes a part, whose files are a bounded number.
    dealt = placed.repartition("corpus", "part").sortWithinPartitions("corpus", "part", "path")
    dealt.select("path", "src", "n", "corpus", "part").write.partitionBy("corpus", "part").option("parquet.block.size", GROUP).parquet(folder)
    return Store(spark, folder, index)
