"""From raw entities and links to the canonical graph, and its derived tables.

Nodes are (corpus, id, label, kind, path, loc), links (corpus, s, t, rel, conf); c, the community, may follow. Every table
is keyed by corpus, so one job serves many.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.vocabulary import INFERRED_FACTOR, KINDS, OTHER_WEIGHT, RELATION_WEIGHT, STRUCTURAL


def hashed(side: DataFrame) -> DataFrame:
    """The nodes in a join with edges: they are fewer and distinct, so their parts are hash tables and the edges aren't sorted."""
    return side.hint("shuffle_hash")


def relation_weight(rel="rel", conf="conf"):
    weight = F.lit(OTHER_WEIGHT)
    for name, value in RELATION_WEIGHT.items():
        weight = F.when(F.col(rel) == name, value).otherwise(weight)
    return F.when(F.col(conf) == "INFERRED", weight * INFERRED_FACTOR).otherwise(weight)


def canonical_edges(links: DataFrame) -> DataFrame:
    """Links with defaults for a missing relation and confidence, and their weight in a layout."""
    return links.select(
        "corpus", "s", "t", relation_weight().alias("weight"), F.coalesce("rel", F.lit("related")).alias("rel"),
        F.coalesce("conf", F.lit("EXTRACTED")).alias("conf"),
    )


def external_nodes(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """One node of kind external for every end of a link that is no node."""
    return external_ends(nodes, links.select("corpus", F.explode(F.array("s", "t")).alias("id")).distinct())  # first: links are many, ends few


def external_ends(nodes: DataFrame, ends: DataFrame) -> DataFrame:
    """The same for distinct ends(corpus, id) of links."""
    missing = ends.join(nodes.select("corpus", "id"), ["corpus", "id"], "left_anti").where("id is not null")
    none = F.lit(None).cast("string")
    return missing.select("corpus", "id", F.col("id").alias("label"), F.lit("external").alias("kind"), none.alias("path"), none.alias("loc"))


def canonical_nodes(nodes: DataFrame, links: DataFrame) -> DataFrame:
    return with_external(nodes, external_nodes(nodes, links))


def with_external(nodes: DataFrame, external: DataFrame) -> DataFrame:
    kind = F.when(F.col("kind").isin(KINDS), F.col("kind")).otherwise("other")
    own = nodes.withColumns({"label": F.coalesce("label", "id"), "kind": kind})
    return own.unionByName(external, allowMissingColumns=True)


def graph_counts(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Counts of canonical nodes, edges and externals by corpus."""
    of_nodes = nodes.groupBy("corpus").agg(F.count("*").alias("nodes"), F.count_if(F.col("kind") == "external").alias("external"))
    return of_nodes.join(edges.groupBy("corpus").agg(F.count("*").alias("edges")), "corpus", "left").select(
        "corpus", "nodes", F.coalesce("edges", F.lit(0)).cast("long").alias("edges"), "external"
    )


def first_by(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The first row of each key by ``order``: how repeated declarations and links are resolved."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.min_by(F.struct(*rest), order).alias("row")).select(*keys, "row.*")


def adjacency(edges: DataFrame) -> DataFrame:
    """Every edge from both its ends: out for the one that depends on the other."""
    out = edges.select("corpus", F.col("s").alias("id"), F.col("t").alias("nbr"), "rel", "conf", F.lit("out").alias("dir"))
    back = edges.select("corpus", F.col("t").alias("id"), F.col("s").alias("nbr"), "rel", "conf", F.lit("in").alias("dir"))
    return out.unionByName(back)


def undirected(edges: DataFrame) -> DataFrame:
    """Edges without loops or direction: a < b."""
    return edges.where("s <> t").select("corpus", F.least("s", "t").alias("a"), F.greatest("s", "t").alias("b"), "weight")


def collapsed_edges(nodes: DataFrame | None, edges: DataFrame) -> DataFrame:
    """Undirected edges between nodes, the strongest of parallels, no loops: a < b. Without ``nodes`` all ends are nodes, as in a
    canonical graph."""
    one = undirected(edges).groupBy("corpus", "a", "b").agg(F.max("weight").alias("weight"))
    for end in ("a", "b") if nodes is not None else ():
        one = one.join(nodes.select("corpus", F.col("id").alias(end)), ["corpus", end], "left_semi")
    return one.select("corpus", "a", "b", "weight")


def degrees(nodes: DataFrame, collapsed: DataFrame) -> DataFrame:
    ends = collapsed.select("corpus", F.explode(F.array("a", "b")).alias("id")).groupBy("corpus", "id").agg(F.count("*").alias("degree"))
    return nodes.select("corpus", "id").join(ends, ["corpus", "id"], "left").select(
        "corpus", "id", F.coalesce("degree", F.lit(0)).cast("long").alias("degree")
    )


def radii(degree: DataFrame) -> DataFrame:
    """Drawn size of each node against the largest degree of its corpus, two decimals."""
    most = degree.groupBy("corpus").agg(F.max("degree").alias("most"))
    share = F.when(F.col("most") > 0, F.sqrt(F.col("degree") / F.col("most"))).otherwise(0.0)
    return degree.join(F.broadcast(most), "corpus").select("corpus", "id", "degree", F.round(3 + share * 14, 2).alias("r"))


def usage(edges: DataFrame) -> DataFrame:
    """Edges that say one entity uses another: all but structural ones."""
    return edges.where(~F.col("rel").isin(STRUCTURAL))


def visible(nodes: DataFrame, edges: DataFrame, kinds: list[str]) -> tuple[DataFrame, DataFrame]:
    """Nodes of the wanted kinds, and the edges with both ends among them."""
    shown = nodes.where(F.col("kind").isin(kinds))
    ids = shown.select("corpus", "id")
    for end in ("s", "t"):
        edges = edges.join(hashed(ids.withColumnRenamed("id", end)), ["corpus", end], "left_semi")
    return shown, edges


def neighbours_by_relation(adjacent: DataFrame) -> DataFrame:
    """How many neighbours each node has by relation and direction, the largest groups first within a node."""
    counted = adjacent.groupBy("corpus", "id", "rel", "dir").agg(F.count("*").alias("n"))
    order = Window.partitionBy("corpus", "id").orderBy(F.desc("n"), "rel", "dir")
    return counted.withColumn("rank", F.row_number().over(order))


def isolation(nodes: DataFrame, community: int) -> DataFrame:
    """The entities that stay lit when one community is singled out: its own, in every corpus."""
    return nodes.where(F.col("c") == community).select("corpus", "id")


def edge_styles(edges: DataFrame, nodes: DataFrame, highlighted: DataFrame) -> DataFrame:
    """How each edge is drawn: hot between two highlighted nodes, dim otherwise if anything is highlighted, else a
    bridge between communities or normal within one."""
    side = nodes.select("corpus", "id", "c")
    lit = highlighted.select("corpus", "id", F.lit(True).alias("lit")).distinct()
    out = edges
    for end in ("s", "t"):
        mine = side.join(lit, ["corpus", "id"], "left").select("corpus", F.col("id").alias(end), F.col("c").alias(f"c_{end}"), F.coalesce("lit", F.lit(False)).alias(f"lit_{end}"))
        out = out.join(hashed(mine), ["corpus", end])
    any_lit = lit.groupBy("corpus").agg(F.lit(True).alias("any"))
    out = out.join(F.broadcast(any_lit), "corpus", "left")
    style = (
        F.when(F.col("lit_s") & F.col("lit_t"), "hot").when(F.col("any"), "dim")
        .when(~F.col("c_s").eqNullSafe(F.col("c_t")), "bridge").otherwise("normal")
    )
    return out.select("corpus", "s", "t", "rel", style.alias("style"))


def file_nodes(nodes: DataFrame) -> DataFrame:
    """The entity that stands for each file: the one that starts first in it, and how many it holds."""
    line = F.coalesce(F.regexp_extract("loc", "([0-9]+)", 1).try_cast("int"), F.lit(0))
    own = nodes.where("path is not null")
    return own.groupBy("corpus", "path").agg(F.min_by("id", F.struct(line, "id")).alias("id"), F.count("*").alias("entities"))


def same_file_neighbours(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(corpus, id, nbr, rel) for both ends of every edge inside one file."""
    at = lambda end: nodes.where("path is not null").select("corpus", F.col("id").alias(end), F.col("path").alias(f"{end}_path"))
    inside = edges.where("s <> t").select("corpus", "s", "t", "rel").join(hashed(at("s")), ["corpus", "s"]).join(hashed(at("t")), ["corpus", "t"]).where("s_path = t_path")
    ends = F.explode(F.array(F.struct(F.col("s").alias("id"), F.col("t").alias("nbr")), F.struct(F.col("t").alias("id"), F.col("s").alias("nbr")))).alias("e")
    return inside.select("corpus", "rel", ends).select("corpus", "e.id", "e.nbr", "rel").distinct()
