"""Differences between two builds, and architectural drift."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .graph import usage


def _changes(before: DataFrame, after: DataFrame, keys: list[str]) -> DataFrame:
    added = after.join(before, keys, "left_anti").withColumn("change", F.lit("added"))
    return added.unionByName(before.join(after, keys, "left_anti").withColumn("change", F.lit("removed")))


def node_diff(before: DataFrame, after: DataFrame) -> DataFrame:
    """Entities added and removed, by id."""
    cols = ["corpus", "id", "label", "path"]
    return _changes(before.select(*cols), after.select(*cols), ["corpus", "id"])


def file_diff(before: DataFrame, after: DataFrame) -> DataFrame:
    """Files added and removed, by the paths of entities."""
    paths = [n.where("path is not null").select("corpus", "path").distinct() for n in (before, after)]
    return _changes(*paths, ["corpus", "path"])


def edge_diff(before: DataFrame, after: DataFrame) -> DataFrame:
    """Dependencies added and removed, by source, target and relation; structural ones are no dependencies."""
    keys = ["corpus", "s", "t", "rel"]
    return _changes(*(usage(e).select(*keys).distinct() for e in (before, after)), keys)


def subsystem(nodes: DataFrame, communities: DataFrame) -> DataFrame:
    """The label of each entity's community: numbers are dealt anew in every build, labels stay."""
    named = communities.select("corpus", F.col("community").alias("c"), F.col("label").alias("name"))
    name = F.coalesce("name", F.concat(F.lit("#"), F.col("c").cast("string")))
    return nodes.join(named, ["corpus", "c"], "left").select("corpus", "id", "label", "kind", name.alias("subsystem"))


def drift(before: tuple[DataFrame, DataFrame, DataFrame], after: tuple[DataFrame, DataFrame, DataFrame], strict_new_subsystem: bool = True) -> DataFrame:
    """Dependencies by which old code reaches into another subsystem. A build is (nodes, edges, communities).

    The edge is new, its source was there before, its target is no external, and the two stand in subsystems of
    different labels in the later build. strict_new_subsystem: edges go whose source reached that subsystem before.
    """
    (nodes0, edges0, groups0), (nodes1, edges1, groups1) = before, after
    new = edge_diff(edges0, edges1).where("change = 'added'").drop("change")
    new = new.join(nodes0.select("corpus", F.col("id").alias("s")), ["corpus", "s"], "left_semi")
    sides = subsystem(nodes1, groups1)
    source = sides.select("corpus", F.col("id").alias("s"), F.col("label").alias("source_label"), F.col("subsystem").alias("from_subsystem"))
    target = sides.where("kind <> 'external'").select("corpus", F.col("id").alias("t"), F.col("label").alias("target_label"), F.col("subsystem").alias("into_subsystem"))
    out = new.join(source, ["corpus", "s"]).join(target, ["corpus", "t"]).where("from_subsystem <> into_subsystem")
    if strict_new_subsystem:
        old = subsystem(nodes0, groups0).select("corpus", F.col("id").alias("t"), F.col("subsystem").alias("into_subsystem"))
        known = usage(edges0).select("corpus", "s", "t").join(old, ["corpus", "t"]).select("corpus", "s", "into_subsystem").distinct()
        out = out.join(known, ["corpus", "s", "into_subsystem"], "left_anti")
    return out.select("corpus", "s", "t", "rel", "source_label", "target_label", "from_subsystem", "into_subsystem")


def subsystem_counts(before: DataFrame, after: DataFrame) -> DataFrame:
    """Communities in the earlier and the later build."""
    counted = [c.groupBy("corpus").agg(F.count("*").alias(n)) for c, n in ((before, "before"), (after, "after"))]
    return counted[0].join(counted[1], "corpus", "full").fillna(0, ["before", "after"])
