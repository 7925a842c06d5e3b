"""Reading repositories and document collections into tables of files."""

from __future__ import annotations

import io
import zipfile

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import basename, extension
from ..functions.vocabulary import (
    CAPTURE_BUDGET, DOCUMENTS, INTERESTING, MANIFESTS, MINIFIED_LENGTH, MINIFIED_LINE, MOST_CAPTURED_BYTES,
    MOST_PDF_BYTES, MOST_SOURCE_BYTES, PARSEABLE, READABLE, READABLE_NAMES, SKIPPED, SKIPPED_FOR_CAPTURE, WORKFLOW,
)
from ..plans.storage import materialize, running_sum


def is_readable(path="path"):
    return extension(path).isin(READABLE) | basename(path).isin(READABLE_NAMES)


def is_parseable(path="path"):
    return extension(path).isin(PARSEABLE)


def is_skipped(path="path", folders: list[str] = SKIPPED):
    return F.arrays_overlap(F.split(path, "/"), F.array(*map(F.lit, folders)))


def looks_minified(src="src"):
    """Long texts of very long lines."""
    return (F.length(src) > MINIFIED_LENGTH) & (F.length(src) / F.size(F.split(src, "\n")) > MINIFIED_LINE)


def is_interesting(path="path"):
    """Documents, manifests, container and workflow files: worth keeping though no entity stands in them."""
    return basename(path).rlike(INTERESTING) | basename(path).isin(MANIFESTS) | F.col(path).rlike(WORKFLOW)


def strip_common_root(files: DataFrame) -> DataFrame:
    """Paths without their first folder where all of a corpus share it."""
    first = F.substring_index("path", "/", 1)
    roots = files.groupBy("corpus").agg(F.min(first).alias("lo"), F.max(first).alias("hi"), F.bool_and(F.contains("path", F.lit("/"))).alias("deep"))
    strip = roots.where("lo = hi and deep").select("corpus", F.lit(True).alias("strip"))
    path = F.when(F.col("strip"), F.regexp_replace("path", "^[^/]*/", "")).otherwise(F.col("path"))
    return files.join(F.broadcast(strip), "corpus", "left").withColumn("path", path).drop("strip")


def read_folder(spark: SparkSession, folder: str, corpus: str | None = None) -> DataFrame:
    """Source files under a folder, as (corpus, path, src): readable ones outside skipped folders, of at most
    MOST_SOURCE_BYTES, not minified. Filters on names run before any content is read."""
    root = folder.rstrip("/")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    name = F.lit(corpus or root.rsplit("/", 1)[-1] or "repo")
    path = F.regexp_replace(F.col("path"), "^.*?" + _escaped(root.split(":", 1)[-1].lstrip("/")) + "/", "")
    found = files.where(F.col("length") <= MOST_SOURCE_BYTES).select(name.alias("corpus"), path.alias("path"), "content")
    found = found.where(is_readable() & ~is_skipped())
    found = found.select("corpus", "path", F.decode("content", "utf-8").alias("src"))
    return found.where(~looks_minified())


def _escaped(text: str) -> str:
    return "\\Q" + text + "\\E"


def source_files(files: DataFrame) -> DataFrame:
    """The filters of ``read_folder`` on files(corpus, path, src) that are there already."""
    small = F.octet_length("src") <= MOST_SOURCE_BYTES
    return files.where((F.col("path") != "") & is_readable() & ~is_skipped() & small & ~looks_minified())


def parseable(files: DataFrame) -> DataFrame:
    return files.where(is_parseable())


def _unzipped(batches):
    """One archive at a time; of its entries only those that pass the filters are unpacked."""
    for batch in batches:
        for corpus, content in zip(batch.column("corpus").to_pylist(), batch.column("content").to_pylist(), strict=True):
            with zipfile.ZipFile(io.BytesIO(content)) as archive:
                for info in archive.infolist():
                    name = info.filename
                    end = name.rsplit("/", 1)[-1]
                    dot = end.rfind(".")
                    known = (dot >= 0 and end[dot:] in READABLE) or end in READABLE_NAMES
                    if info.is_dir() or not known or info.file_size > MOST_SOURCE_BYTES or set(name.split("/")) & set(SKIPPED):
                        continue
                    text = archive.read(info).decode("utf-8", "replace")
                    yield pa.RecordBatch.from_arrays([pa.array([corpus]), pa.array([name]), pa.array([text])], ["corpus", "path", "src"])


def read_zips(archives: DataFrame) -> DataFrame:
    """Source files of archives(corpus, content), a root folder common to a whole archive removed."""
    files = archives.select("corpus", "content").mapInArrow(_unzipped, "corpus string, path string, src string")
    return strip_common_root(files).where(~looks_minified())


def zip_name(path="path"):
    return F.coalesce(F.nullif(F.regexp_replace(basename(path), r"(?i)\.zip$", ""), F.lit("")), F.lit("repo"))


def folder_name(path="path"):
    return F.coalesce(F.nullif(F.substring_index(path, "/", 1), F.lit("")), F.lit("repo"))


def document_files(files: DataFrame) -> DataFrame:
    """Documents among files(corpus, path, bytes, ...): by extension, outside skipped folders, by size; roots stripped."""
    end = F.lower(F.regexp_extract("path", r"\.[^.]*$", 0))
    most = F.when(end == ".pdf", MOST_PDF_BYTES).otherwise(MOST_SOURCE_BYTES)
    return strip_common_root(files.where(end.isin(DOCUMENTS) & ~is_skipped() & (F.col("bytes") <= most)))


def read_canonical_json(spark: SparkSession, path: str, corpus: str) -> tuple[DataFrame, DataFrame]:
    """A canonical or raw graph file as nodes and links. Edges of the former are arrays of five by position. A file that is neither,
    without nodes or with neither edges nor links, is an error."""
    schema = (
        "nodes array<struct<id:string,label:string,kind:string,file_type:string,source_file:string,source_location:string,"
        "attrs:struct<path:string,loc:string>>>, edges array<array<string>>, links array<struct<source:string,target:string,"
        "relation:string,confidence:string,context:string,source_file:string,source_location:string>>"
    )
    doc = spark.read.schema(schema).json(path, multiLine=True)
    if doc.where("nodes IS NULL OR (edges IS NULL AND links IS NULL)").limit(1).count():
        raise ValueError(f"{path} holds no graph: nodes with edges or links are missing")
    node = doc.select(F.explode("nodes").alias("n")).select("n.*")
    nodes = node.select(
        F.lit(corpus).alias("corpus"), "id", "label", F.coalesce("kind", "file_type").alias("kind"),
        F.coalesce("attrs.path", "source_file").alias("path"), F.coalesce("attrs.loc", "source_location").alias("loc"),
    )
    by_place = doc.select(F.explode("edges").alias("e")).select(
        F.lit(corpus).alias("corpus"), F.get("e", F.lit(0)).alias("s"), F.get("e", F.lit(1)).alias("t"),
        F.get("e", F.lit(3)).alias("rel"), F.get("e", F.lit(4)).alias("conf"),
    )
    by_name = doc.select(F.explode("links").alias("l")).select(
        F.lit(corpus).alias("corpus"), F.col("l.source").alias("s"), F.col("l.target").alias("t"),
        F.col("l.relation").alias("rel"), F.col("l.confidence").alias("conf"),
    )
    return nodes, by_place.unionByName(by_name)


def captured_sources(files: DataFrame, nodes: DataFrame, budget: int = CAPTURE_BUDGET) -> DataFrame:
    """Files to keep beside a graph: all that entities stand in, and of the interesting others, shallowest first, as many
    as a running budget takes; one too large for what is left is passed over and the next one tried.

    The greedy choice goes in rounds over sizes, by sums that run over ranges of the order: the leading files that fit are
    taken, all that are larger than what is left are passed over, and the rest goes on. Every round takes a file or
    ends the choice of its corpus.
    """
    sized = files.withColumn("n", F.octet_length("src").cast("long")).where((F.col("n") <= MOST_CAPTURED_BYTES) & ~looks_minified())
    on_graph = nodes.where("path is not null").select("corpus", "path").distinct()
    mapped = sized.join(on_graph, ["corpus", "path"], "left_semi").drop("n")
    extra = sized.join(on_graph, ["corpus", "path"], "left_anti").where(is_interesting() & ~is_skipped(folders=SKIPPED_FOR_CAPTURE))
    rest = materialize(extra.select("corpus", F.size(F.split("path", "/")).alias("depth"), "path", "n", F.lit(budget).cast("long").alias("free")), "capture")
    taken = rest.select("corpus", "path").limit(0)
    while not rest.isEmpty():
        summed = materialize(running_sum(rest, "corpus", ["depth", "path"], "n", "sum"), "capture")
        fits = summed.where("sum <= free")
        taken = taken.unionByName(fits.select("corpus", "path"))
        spent = fits.groupBy("corpus").agg(F.max("sum").alias("spent"))
        left = summed.where("sum > free").join(F.broadcast(spent), "corpus", "left").withColumn("free", F.col("free") - F.coalesce("spent", F.lit(0)))
        rest = materialize(left.where("n <= free").select("corpus", "depth", "path", "n", "free"), "capture")
    return mapped.unionByName(extra.join(taken, ["corpus", "path"], "left_semi").drop("n"))


def glyph_lines(glyphs: DataFrame, bucket: float = 2.0) -> DataFrame:
    """Lines of a PDF's glyph runs(corpus, path, page, x, y, h, str): runs of like height on the page, top down, and
    which of them are headings: taller than the document's median by 1.18 (level 2) or 1.5 (level 1), 90 characters
    at most."""
    line = glyphs.groupBy("corpus", "path", "page", F.round(F.col("y") / bucket).alias("row")).agg(
        F.sort_array(F.collect_list(F.struct("x", "str"))).alias("runs"), F.max("h").alias("h")
    )
    ordered = Window.partitionBy("corpus", "path").orderBy("h")
    size = Window.partitionBy("corpus", "path")
    place = glyphs.withColumns({"i": F.row_number().over(ordered) - 1, "m": F.floor(F.count("*").over(size) / 2)})
    median = place.where("i = m").select("corpus", "path", F.col("h").alias("median"))
    text = F.trim(F.regexp_replace(F.array_join(F.transform("runs", lambda r: r.getField("str")), ""), r"\s+", " "))
    out = line.withColumn("text", text).where("text <> ''").join(median, ["corpus", "path"])
    tall = (F.length("text") <= 90) & (F.col("h") >= 1.18 * F.col("median"))
    level = F.when(tall & (F.col("h") >= 1.5 * F.col("median")), 1).when(tall, 2).otherwise(0)
    rank = F.row_number().over(Window.partitionBy("corpus", "path").orderBy("page", F.desc("row")))
    return out.select("corpus", "path", "page", rank.alias("line"), level.alias("level"), "text")
