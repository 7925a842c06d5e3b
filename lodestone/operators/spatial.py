"""What is under a point of a map: a range join by grid cells."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.storage import discard, materialize

CELL, LEAST_RADIUS = 600, 12


def _discs(nodes: DataFrame, r) -> DataFrame:
    """(corpus, id, nx, ny, r): of equal discs in one place the smallest id, as no other is ever hit."""
    return nodes.groupBy("corpus", F.col("x").alias("nx"), F.col("y").alias("ny"), r.alias("r")).agg(F.min("id").alias("id"))


def _places(points: DataFrame) -> DataFrame:
    """The places of the points, each once: what is under it is searched for once however many points are there."""
    return points.where("x IS NOT NULL AND y IS NOT NULL").select("corpus", "x", "y").distinct()


def _told(points: DataFrame, met: DataFrame) -> DataFrame:
    """(corpus, point, id, distance) of the points, by the nearest of what their places met(corpus, x, y, d2, id)."""
    best = met.groupBy("corpus", "x", "y").agg(F.min(F.struct("d2", "id")).alias("best"))
    found = points.select("corpus", "point", "x", "y").join(best, ["corpus", "x", "y"])
    found = found.groupBy("corpus", "point").agg(F.min("best").alias("best"))  # a point that is told twice has one row
    return found.select("corpus", "point", "best.id", F.round(F.sqrt("best.d2"), 6).alias("distance"))


def hit_test(nodes: DataFrame, points: DataFrame, cell: int = CELL) -> DataFrame:
    """For each of points(corpus, point, x, y) the nearest node of nodes(corpus, id, x, y, r) whose disc it is in; discs
    have at least LEAST_RADIUS. A point meets the nodes of its cell and the eight around it."""
    discs = _discs(nodes, F.col("r"))
    grid = discs.select("*", F.floor(F.col("nx") / cell).alias("gx"), F.floor(F.col("ny") / cell).alias("gy"))
    around = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)]))
    near = _places(points).select("corpus", "x", "y", around.alias("o"))
    near = near.select("corpus", "x", "y", (F.floor(F.col("x") / cell) + F.col("o.i")).alias("gx"), (F.floor(F.col("y") / cell) + F.col("o.j")).alias("gy"))
    dx, dy = F.col("nx") - F.col("x"), F.col("ny") - F.col("y")
    met = near.join(grid, ["corpus", "gx", "gy"]).withColumn("d2", dx * dx + dy * dy)
    return _told(points, met.where(F.col("d2") < F.greatest("r", F.lit(float(LEAST_RADIUS))) ** 2))


def exact_hit(nodes: DataFrame, points: DataFrame, scale: float = 1.0) -> DataFrame:
    """For each of points(corpus, point, x, y) the nearest node whose disc it is in, of any size: (corpus, point, id, distance).

    A disc has the node's r, or LEAST_RADIUS on screen at this scale if that is more. Discs are put on grids by their size, each
    into the four cells at most that it can touch where a cell is twice as wide as its class's largest radius. A point looks
    into one cell of each size that occurs. A point on a disc's rim is outside; of equally near nodes the smaller id.
    """
    reach = F.greatest(F.coalesce("r", F.lit(0.0)), F.lit(LEAST_RADIUS / scale))
    level = F.ceil(F.log2("reach")).cast("int")
    cell = F.pow(F.lit(2.0), F.col("level") + 1)
    grid = _discs(nodes, reach).withColumnRenamed("r", "reach").withColumn("level", level)
    over = lambda c: F.sequence(F.floor((F.col(c) - F.col("reach")) / cell), F.floor((F.col(c) + F.col("reach")) / cell))
    grid = grid.withColumn("gx", F.explode(over("nx"))).withColumn("gy", F.explode(over("ny")))
    levels = grid.select("corpus", "level").distinct()  # one row a power of two
    seen = _places(points).join(F.broadcast(levels), "corpus")
    seen = seen.select("corpus", "x", "y", "level", F.floor(F.col("x") / cell).alias("gx"), F.floor(F.col("y") / cell).alias("gy"))
    dx, dy = F.col("nx") - F.col("x"), F.col("ny") - F.col("y")
    met = seen.join(grid, ["corpus", "level", "gx", "gy"]).withColumn("d2", dx * dx + dy * dy).where("d2 < reach * reach")
    return _told(points, met)


#: Nodes that a cell of the finest grid has on average, and the most times that cells are halved.
LEAF, DEPTH = 4, 14


def nearest(nodes: DataFrame, points: DataFrame) -> DataFrame:
    """For each of points(corpus, point, x, y) the nearest node, however far: (corpus, point, id, distance); of equally near ones
    the smaller id. A point of a corpus without nodes has no row; nodes and points without a place are left out.

    Nodes stand in a pyramid of grids over their own box, halved until a cell has LEAF of them on average. A point starts with the
    coarsest cells and goes down: a cell stays while the nearest place of its nodes' box is no farther than the
    farthest place of some other cell's box, where a node is sure to be. So no cell that goes can hold the nearest node, a
    point keeps a handful of cells at each step wherever it is, and only those of the finest grid are searched.
    """
    double = [F.col(c).cast("double").alias(c) for c in ("x", "y")]
    placed = nodes.where("x IS NOT NULL AND y IS NOT NULL").select("corpus", "id", *double).groupBy("corpus", "x", "y").agg(F.min("id").alias("id"))
    box = placed.groupBy("corpus").agg(F.min("x").alias("x0"), F.min("y").alias("y0"), F.greatest(F.max("x") - F.min("x"), F.max("y") - F.min("y")).alias("side"), F.count("*").alias("n"))
    box = materialize(box.withColumn("side", F.when(F.col("side") > 0, F.col("side")).otherwise(1.0)), "pyramid-box")  # one row a corpus
    most = box.agg(F.max("n")).first()[0]
    depth = min(DEPTH, max(1, math.ceil(math.log((most or 1) / LEAF, 4)))) if (most or 1) > LEAF else 1
    whole = 1 << depth
    at = lambda c: F.least(F.floor((F.col(c) - F.col(f"{c}0")) / F.col("side") * whole), F.lit(whole - 1))
    placed = placed.join(F.broadcast(box), "corpus").select("corpus", "id", "x", "y", at("x").alias("gx"), at("y").alias("gy"))
    placed = materialize(placed, "pyramid-nodes")
    cells = placed.groupBy("corpus", "gx", "gy").agg(F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1"))
    grids = [materialize(cells, "pyramid")]
    for _ in range(depth - 1):
        up = grids[-1].groupBy("corpus", F.shiftright("gx", 1).alias("gx"), F.shiftright("gy", 1).alias("gy"))
        grids.append(materialize(up.agg(F.min("x0").alias("x0"), F.max("x1").alias("x1"), F.min("y0").alias("y0"), F.max("y1").alias("y1")), "pyramid"))
    points = points.select("corpus", "point", *double)
    near = _places(points).withColumnsRenamed({"x": "px", "y": "py"})
    open_ = None
    for grid in reversed(grids):
        if open_ is None:
            met = near.join(F.broadcast(grid), "corpus")  # four cells at most
        else:
            down = grid.withColumns({"ux": F.shiftright("gx", 1), "uy": F.shiftright("gy", 1)})
            met = open_.join(down, ["corpus", "ux", "uy"])
        outside = lambda p, lo, hi: F.greatest(F.col(lo) - F.col(p), F.col(p) - F.col(hi), F.lit(0.0))
        beyond = lambda p, lo, hi: F.greatest(F.abs(F.col(p) - F.col(lo)), F.abs(F.col(p) - F.col(hi)))
        met = met.withColumn("close", F.pow(outside("px", "x0", "x1"), F.lit(2)) + F.pow(outside("py", "y0", "y1"), F.lit(2)))
        met = met.withColumn("far", F.pow(beyond("px", "x0", "x1"), F.lit(2)) + F.pow(beyond("py", "y0", "y1"), F.lit(2)))
        # A shade wider than the bound: squares are rounded.
        met = met.withColumn("bound", F.min("far").over(Window.partitionBy("corpus", "px", "py"))).where(F.col("close") <= F.col("bound") * (1 + 1e-9))
        before, open_ = open_, materialize(met.select("corpus", "px", "py", F.col("gx").alias("ux"), F.col("gy").alias("uy")), "pyramid-open")
        discard(grid, *([before] if before is not None else []))
    dx, dy = F.col("x") - F.col("px"), F.col("y") - F.col("py")
    met = open_.withColumnsRenamed({"ux": "gx", "uy": "gy"}).join(placed, ["corpus", "gx", "gy"]).withColumn("d2", dx * dx + dy * dy)
    return _told(points, met.select("corpus", F.col("px").alias("x"), F.col("py").alias("y"), "d2", "id"))
