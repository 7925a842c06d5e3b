"""The file tree of a set of paths, as flat tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import ancestors, basename


def _parent(path):
    return F.when(F.contains(path, F.lit("/")), F.regexp_replace(path, "/[^/]*$", "")).otherwise("")


def entries(paths: DataFrame) -> DataFrame:
    """Every file and folder once: (corpus, path, name, parent, depth, is_dir); siblings are ordered folders first, by
    name, in ``rank``."""
    files = paths.select("corpus", "path").distinct()
    folders = files.select("corpus", F.explode(ancestors("path")).alias("path")).distinct().withColumn("is_dir", F.lit(True))
    own = files.join(folders.select("corpus", "path"), ["corpus", "path"], "left_anti").withColumn("is_dir", F.lit(False))
    out = folders.unionByName(own).select(
        "corpus", "path", basename("path").alias("name"), _parent(F.col("path")).alias("parent"), F.size(F.split("path", "/")).alias("depth"), "is_dir"
    )
    order = Window.partitionBy("corpus", "parent").orderBy(F.desc("is_dir"), "name")
    return out.withColumn("rank", F.row_number().over(order))


def collapsed(tree: DataFrame) -> DataFrame:
    """Folders with chains of single folders as one: (corpus, path, name, head). A folder whose only child is a folder is
    part of that one; head is where the chain starts, name spans it.

    No walk is needed: a folder's ancestors are in its path, and the chain starts below the nearest one that branches.
    """
    kids = tree.groupBy("corpus", F.col("parent").alias("path")).agg(F.count("*").alias("n"), F.bool_and("is_dir").alias("dirs"))
    single = kids.where("n = 1 and dirs and path <> ''").select("corpus", "path")
    folders = tree.where("is_dir")
    shown = folders.join(single, ["corpus", "path"], "left_anti").select("corpus", "path")
    above = shown.select("corpus", "path", F.posexplode(ancestors("path")).alias("pos", "up"))
    branching = above.join(single.withColumnRenamed("path", "up"), ["corpus", "up"], "left_anti").groupBy("corpus", "path").agg(F.max("pos").alias("last"))
    named = shown.join(branching, ["corpus", "path"], "left")
    parts = F.split("path", "/")
    skip = F.coalesce(F.col("last") + 1, F.lit(0))
    name = F.array_join(F.slice(parts, skip + 1, F.size(parts)), "/")
    head = F.array_join(F.slice(parts, F.lit(1), skip + 1), "/")
    return named.select("corpus", "path", name.alias("name"), head.alias("head"))


def file_counts(paths: DataFrame) -> DataFrame:
    return paths.groupBy("corpus").agg(F.count_distinct("path").alias("files"))


def filtered(entries: DataFrame, query: str) -> DataFrame:
    """The entries of files whose path holds ``query``, whatever its case, and of the folders above them."""
    hits = entries.where(~F.col("is_dir") & F.contains(F.lower("path"), F.lit(query.strip().lower()))).select("corpus", "path")
    above = hits.select("corpus", F.explode(ancestors("path")).alias("path"))
    return entries.join(hits.unionByName(above).distinct(), ["corpus", "path"], "left_semi")
