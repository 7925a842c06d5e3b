"""Literal search in texts, the ranked palette, and the entity box."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import basename, context, match_score
from ..plans.storage import running_sum

PER_FILE, BATCH, MOST_MATCHES = 20, 12, 300
LIMITS = {"Entities": 8, "Files": 8, "Commands": 6, "Recent files": 6}
COMMAND_BIAS = 120
BOX_HITS, BOX_ROWS = 401, 12


def line_matches(files: DataFrame, query: str, per_file: int = PER_FILE) -> DataFrame:
    """The first ``per_file`` lines of each of files(corpus, path, src) that hold ``query``, whatever their case: line
    and column (from 0) of the first match in each, and its context. Texts without it are never split."""
    needle = query.lower()
    holding = files.where(F.contains(F.lower("src"), F.lit(needle)))
    lines = holding.select("corpus", "path", F.posexplode(F.split("src", "\n")).alias("pos", "text"))
    hits = lines.withColumn("col", F.position(F.lit(needle), F.lower("text")) - 1).where("col >= 0")
    rank = F.row_number().over(Window.partitionBy("corpus", "path").orderBy("pos"))
    hits = hits.withColumn("rank", rank).where(F.col("rank") <= per_file)
    trimmed = context("text", "col", F.lit(len(needle)))
    return hits.select("corpus", "path", (F.col("pos") + 1).alias("line"), "col", trimmed.alias("context"))


def literal_search(files: DataFrame, query: str, limit: int = MOST_MATCHES, batch: int = BATCH) -> DataFrame:
    """Matches in the order of paths, whole batches of ``batch`` files until ``limit`` is reached, as a reader would
    get them. What is counted over all files are batches, not matches."""
    found = line_matches(files, query)
    placed = running_sum(files.select("corpus", "path", F.lit(1).cast("long").alias("one")), "corpus", ["path"], "one", "n")
    numbered = placed.select("corpus", "path", F.floor((F.col("n") - 1) / batch).alias("batch"))
    counted = found.groupBy("corpus", "path").agg(F.count("*").alias("n")).join(numbered, ["corpus", "path"])
    per = counted.groupBy("corpus", "batch").agg(F.sum("n").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("corpus").orderBy("batch").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    read = per.withColumn("before", before).where(F.col("before") < limit).select("corpus", "batch")
    paths = numbered.join(read, ["corpus", "batch"], "left_semi").select("corpus", "path")
    return found.join(paths, ["corpus", "path"], "left_semi")


def search_summary(found: DataFrame) -> DataFrame:
    per = found.groupBy("corpus", "path").agg(F.count("*").alias("n"))
    return per.groupBy("corpus").agg(F.count("*").alias("files"), F.sum("n").alias("matches"))


def _best(term: str, *fields):
    scores = [match_score(f, term) for f in fields]
    return F.greatest(*scores) if len(scores) > 1 else scores[0]


def palette(nodes: DataFrame, paths: DataFrame, commands: DataFrame, query: str, limits: dict[str, int] = LIMITS) -> DataFrame:
    """Entities, files and commands that match ``query``, each group's best, groups ordered by their best score.

    nodes need r, their drawn size, which adds to the score; commands(corpus, id, label, hint, keywords) have a bonus.
    """
    term = query.strip().lower()
    entity = nodes.select("corpus", F.lit("Entities").alias("section"), F.col("id").alias("item"), "label", (_best(term, "label", "path") + F.coalesce("r", F.lit(0.0))).alias("score"))
    file = paths.select("corpus", F.lit("Files").alias("section"), F.col("path").alias("item"), basename("path").alias("label"), _best(term, basename("path"), "path").cast("double").alias("score"))
    command = commands.select("corpus", F.lit("Commands").alias("section"), F.col("id").alias("item"), "label", (_best(term, "keywords", "label", "hint") + COMMAND_BIAS).cast("double").alias("score"))
    found = entity.unionByName(file).unionByName(command).where("score is not null")
    most = F.lit(0)
    for name, n in limits.items():
        most = F.when(F.col("section") == name, n).otherwise(most)
    rank = F.row_number().over(Window.partitionBy("corpus", "section").orderBy(F.desc("score"), "item"))
    kept = found.withColumn("rank", rank).where((F.col("rank") <= max(limits.values())) & (F.col("rank") <= most))
    return kept.withColumn("top", F.max("score").over(Window.partitionBy("corpus", "section")))


def without_query(recent: DataFrame, commands: DataFrame, limit: int = LIMITS["Recent files"]) -> DataFrame:
    """What the palette shows before anything is typed: recent files, then all commands."""
    w = Window.partitionBy("corpus").orderBy("rank")
    files = recent.withColumn("n", F.row_number().over(w)).where(F.col("n") <= limit)
    files = files.select("corpus", F.lit("Recent files").alias("section"), F.col("path").alias("item"), basename("path").alias("label"))
    return files.unionByName(commands.select("corpus", F.lit("Commands").alias("section"), F.col("id").alias("item"), "label"))


def entity_box(nodes: DataFrame, query: str, hits: int = BOX_HITS, rows: int = BOX_ROWS) -> DataFrame:
    """The entity search box: the first ``hits`` entities by id whose label or path holds the query, best first."""
    term = query.strip().lower()
    label = F.lower("label")
    held = F.contains(label, F.lit(term)) | F.contains(F.lower(F.coalesce("path", F.lit(""))), F.lit(term))
    found = nodes.where(held & F.lit(len(term) >= 2))
    early = Window.partitionBy("corpus").orderBy("id")
    found = found.withColumn("n", F.row_number().over(early)).where(F.col("n") <= hits)
    score = F.when(F.startswith(label, F.lit(term)), 100).otherwise(0) + F.coalesce("r", F.lit(0.0))
    best = Window.partitionBy("corpus").orderBy(F.desc("score"), "id")
    return found.withColumn("score", score).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= rows).select("corpus", "id", "label", "score", "rank")


def map_search(nodes: DataFrame, query: str, rows: int = 12) -> DataFrame:
    """Search in an exported map: the largest entities whose label or path holds the query."""
    term = query.strip().lower()
    held = F.contains(F.lower("label"), F.lit(term)) | F.contains(F.lower(F.coalesce("path", F.lit(""))), F.lit(term))
    rank = F.row_number().over(Window.partitionBy("corpus").orderBy(F.desc("r"), "id"))
    return nodes.where(held).withColumn("rank", rank).where(F.col("rank") <= rows).select("corpus", "id", "label", "r", "rank")


def highlight(text, words: list[str], open_: str = "<mark>", close: str = "</mark>", snippet: int = 420):
    """A text's start with the words marked, longest first."""
    column = F.substring(F.col(text), 1, snippet)
    pattern = "|".join(re.escape(w) for w in sorted(set(words), key=lambda w: (-len(w), w)) if w)
    return F.regexp_replace(column, f"(?i)({pattern})", f"{open_}$1{close}") if pattern else column
