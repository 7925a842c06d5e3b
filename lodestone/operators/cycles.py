"""Dependency cycles: strongly connected components by joins."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.storage import discard, materialize
from .graph import usage

TOP = 10
#: Labels that travel each way at once, and steps to a round.
PIVOTS, HOPS = 3, 4


def _trimmed(edges: DataFrame) -> DataFrame:
    """Without entities that nothing uses or that use nothing: none of them is in a cycle. One round; the components'
    own rounds drop what it leaves."""
    sources, targets = edges.select("corpus", F.col("s").alias("x")).distinct(), edges.select("corpus", F.col("t").alias("x")).distinct()
    both = sources.join(targets, ["corpus", "x"], "left_semi")
    for end in ("s", "t"):
        edges = edges.join(both.withColumnRenamed("x", end), ["corpus", end], "left_semi")
    return edges


def _settled(edges: DataFrame, turn: int) -> tuple[DataFrame, int]:
    """(corpus, id, k, label) and the rounds it took: for each of 2 x PIVOTS label numbers k, the least label (a hash and its
    owner) that reaches the entity along the edges, or for odd k against them.

    A label goes on to all neighbours and, through its owner, to whatever has that owner's new label. As hashes are strewn,
    the stretch a label covers grows by a factor each time, also along one long path. A round is HOPS such steps.
    """
    arcs = edges.select("corpus", F.col("s").alias("x"), F.col("t").alias("y"), F.lit(0).alias("d"))
    arcs = arcs.unionByName(edges.select("corpus", F.col("t").alias("x"), F.col("s").alias("y"), F.lit(1).alias("d")))
    number = F.explode(F.sequence(F.lit(0), F.lit(2 * PIVOTS - 1))).alias("k")
    ids = edges.select("corpus", F.explode(F.array("s", "t")).alias("id")).distinct().select("corpus", "id", number)
    hashed = F.xxhash64("id", F.lit(turn), F.floor(F.col("k") / 2))
    labels = materialize(ids.select("corpus", "id", "k", F.struct(hashed.alias("hash"), F.col("id").alias("owner")).alias("label")), "cycle-labels")
    steps = 0
    while True:
        steps += 1
        own = labels.select("corpus", "id", "k", "label", F.lit(True).alias("own"))
        at = labels.select("corpus", F.col("id").alias("x"), "k", "label", (F.col("k") % 2).alias("d"))
        pushed = arcs.join(at, ["corpus", "x", "d"]).groupBy("corpus", F.col("y").alias("id"), "k").agg(F.min("label").alias("label"))
        pushed = pushed.select("corpus", "id", "k", "label", F.lit(False).alias("own"))
        owners = labels.select("corpus", "k", F.col("id").alias("owner"), F.col("label").alias("further"))
        jumped = labels.withColumn("owner", F.col("label.owner")).join(owners, ["corpus", "k", "owner"])
        jumped = jumped.select("corpus", "id", "k", F.col("further").alias("label"), F.lit(False).alias("own"))
        grouped = own.unionByName(pushed).unionByName(jumped).groupBy("corpus", "id", "k")
        new = grouped.agg(F.min("label").alias("label"), F.max(F.when(F.col("own"), F.col("label"))).alias("was"))
        # A step reads the labels four times: steps in one plan would multiply it, so each is written.
        new = materialize(new.select("corpus", "id", "k", "label", (F.col("was") != F.col("label")).alias("moved")), "cycle-labels")
        discard(labels)
        labels = new
        if labels.where("moved").isEmpty():
            return labels.drop("moved"), math.ceil(steps / HOPS)


def strong_components(edges: DataFrame) -> tuple[DataFrame, int]:
    """(corpus, id, component) of every entity in a cycle of two or more over ``edges`` (corpus, s, t), component being the
    least id in it, and the number of rounds.

    Every entity is a pivot, ranked by hashes that are drawn anew each time. Who has the same label along the edges and
    against them is in its owner's component, all of which is found so and leaves. Entities whose labels differ are never
    in one component, so edges between them leave too, and what is left falls into parts at random places: rounds grow
    with the logarithm of the entities on long cycles and on long chains of small components alike.
    """
    left = edges.where("s <> t").select("corpus", "s", "t").distinct()
    left = materialize(_trimmed(left), "cycle-edges")
    found, rounds, turn = [], 0, 0
    while not left.isEmpty():
        labels, more = _settled(left, turn)
        rounds, turn = rounds + more, turn + 1
        each = [F.max(F.when(F.col("k") == k, F.col("label.owner"))).alias(f"l{k}") for k in range(2 * PIVOTS)]
        owners = labels.groupBy("corpus", "id").agg(*each)
        # Several numbers may find a component, each all of it; the first one names it.
        pivot = F.coalesce(*[F.when(F.col(f"l{k}") == F.col(f"l{k + 1}"), F.struct(F.lit(k).alias("k"), F.col(f"l{k}").alias("owner"))) for k in range(0, 2 * PIVOTS, 2)])
        owners = owners.select("corpus", "id", F.struct(*[f"l{k}" for k in range(2 * PIVOTS)]).alias("all"), pivot.alias("pivot"))
        owners = materialize(owners, "cycle-owners")
        found.append(owners.where("pivot IS NOT NULL").select("corpus", "id", F.lit(turn).alias("turn"), "pivot"))
        rest = owners.where("pivot IS NULL").select("corpus", "id", "all")
        side = lambda end: rest.select("corpus", F.col("id").alias(end), F.col("all").alias(f"at_{end}"))  # noqa: E731, B023
        left = left.join(side("s"), ["corpus", "s"]).join(side("t"), ["corpus", "t"]).where("at_s = at_t").select("corpus", "s", "t")
        left = materialize(_trimmed(left), "cycle-edges")
    if not found:
        return edges.select("corpus", F.col("s").alias("id"), F.col("s").alias("component")).limit(0), 0
    members = reduce(DataFrame.unionByName, found)
    sizes = members.groupBy("corpus", "turn", "pivot").agg(F.min("id").alias("component"), F.count("*").alias("n")).where("n > 1")
    return members.join(sizes, ["corpus", "turn", "pivot"]).select("corpus", "id", "component"), rounds


def components(edges: DataFrame) -> DataFrame:
    """``strong_components`` of the usage edges."""
    return strong_components(usage(edges))[0]


def cycles(nodes: DataFrame, edges: DataFrame, n: int = TOP) -> DataFrame:
    """The largest cycles: size and least id of each."""
    own = edges.join(nodes.select("corpus", F.col("id").alias("s")), ["corpus", "s"], "left_semi").join(nodes.select("corpus", F.col("id").alias("t")), ["corpus", "t"], "left_semi")
    sizes = components(own).groupBy("corpus", "component").agg(F.count("*").alias("size"))
    rank = F.row_number().over(Window.partitionBy("corpus").orderBy(F.desc("size"), "component"))
    return sizes.withColumn("rank", rank).where(F.col("rank") <= n)
