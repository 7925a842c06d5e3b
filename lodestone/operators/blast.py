"""Blast radius: what a change reaches, in how many hops, and whether for certain."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.storage import materialize
from .graph import adjacency

MOST_DEPTH = 6


def _reach(adjacent: DataFrame, roots: DataFrame, depth: int, label: str) -> DataFrame:
    """(corpus, root_set, id, depth, via, from_id): breadth first, a round a hop; an id keeps the first round that met
    it. Each round joins the frontier alone, so a hub is expanded once."""
    none = F.lit(None).cast("string")
    reached = materialize(roots.select("corpus", "root_set", "id", F.lit(0).alias("depth"), none.alias("via"), none.alias("from_id")).distinct(), label)
    frontier = reached
    steps = adjacent.select("corpus", "id", "nbr", "rel")
    for hop in range(1, depth + 1):
        met = frontier.select("corpus", "root_set", "id").join(steps, ["corpus", "id"])
        met = met.groupBy("corpus", "root_set", F.col("nbr").alias("next")).agg(F.min(F.struct(F.col("id").alias("from_id"), F.col("rel").alias("via"))).alias("how"))
        new = met.withColumnRenamed("next", "id").join(reached.select("corpus", "root_set", "id"), ["corpus", "root_set", "id"], "left_anti")
        frontier = materialize(new.select("corpus", "root_set", "id", F.lit(hop).alias("depth"), "how.via", "how.from_id"), label)
        reached = reached.unionByName(frontier)
    return reached


def blast_radius(edges: DataFrame, roots: DataFrame, depth: int = 3, direction: str = "in") -> DataFrame:
    """Entities within ``depth`` hops of each set of roots(corpus, root_set, id); in: what depends on them.

    depth is the least number of hops over all edges; certain: within ``depth`` hops over edges read from source alone.
    via and from_id tell one of the first edges that led there, by least id. Roots themselves, cycles back to them and
    roots that do not exist give no rows.
    """
    if not 1 <= depth <= MOST_DEPTH or direction not in ("in", "out"):
        raise ValueError("depth is 1 to 6, direction in or out")
    adjacent = materialize(adjacency(edges).where(F.col("dir") == direction), "adjacency")
    reached = _reach(adjacent, roots, depth, "blast")
    sure = _reach(adjacent.where("conf <> 'INFERRED'"), roots, depth, "blast-certain")
    sure = sure.select("corpus", "root_set", "id", F.col("depth").alias("sure_depth"))
    out = reached.where("depth > 0").join(sure, ["corpus", "root_set", "id"], "left")
    return out.select("corpus", "root_set", "id", "depth", F.col("sure_depth").isNotNull().alias("certain"), "via", "from_id")


def rings(reached: DataFrame) -> DataFrame:
    """How many entities each hop adds, and how many of them for certain."""
    return reached.groupBy("corpus", "root_set", "depth").agg(F.count("*").alias("n"), F.count_if("certain").alias("n_certain"))


def ring_order(reached: DataFrame, radii: DataFrame) -> DataFrame:
    """The entities of each ring by size, largest first: radii(corpus, id, r), ties by id. Each ring is numbered from 1."""
    order = Window.partitionBy("corpus", "root_set", "depth").orderBy(F.desc("r"), "id")
    out = reached.join(radii.select("corpus", "id", "r"), ["corpus", "id"]).withColumn("rank", F.row_number().over(order))
    return out.select("corpus", "root_set", "depth", "id", "r", "rank")
