"""The history of a corpus: what each of its saved builds has changed against the one before."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .graph import usage


def chain(builds: DataFrame) -> DataFrame:
    """(corpus, build, no, before, last): each corpus's builds(corpus, build, saved_at) in order of time, numbered from 1; of
    one time by build. before: the build before it, null for the first. last: how many there are.

    The builds of a corpus are few (retention keeps a handful), so a window over them is small.
    """
    order = Window.partitionBy("corpus").orderBy("saved_at", "build")
    rows = builds.select("corpus", "build", "saved_at").distinct()
    number = F.row_number().over(order)
    return rows.select("corpus", "build", number.alias("no"), F.lag("build").over(order).alias("before"), F.count("*").over(Window.partitionBy("corpus")).alias("last"))


def ordered(picked: DataFrame, builds: DataFrame) -> DataFrame:
    """Pairs of builds picked(corpus, one, other) as (corpus, before, after): the older is before, however they were picked.
    A build picked twice, or one that is not there, makes no pair."""
    links = chain(builds).select("corpus", "build", "no")
    side = lambda name: links.select("corpus", F.col("build").alias(name), F.col("no").alias(f"{name}_no"))
    met = picked.select("corpus", "one", "other").join(F.broadcast(side("one")), ["corpus", "one"]).join(F.broadcast(side("other")), ["corpus", "other"])
    first = F.col("one_no") < F.col("other_no")
    return met.where("one_no <> other_no").select("corpus", F.when(first, F.col("one")).otherwise(F.col("other")).alias("before"), F.when(first, F.col("other")).otherwise(F.col("one")).alias("after"))


def _things(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Entities, files and dependencies of all builds in one shape: corpus, build, what, key."""
    none = F.lit(None).cast("string")
    of = lambda df, what, id, path, s, t, rel: df.select("corpus", "build", F.lit(what).alias("what"), F.struct(id.alias("id"), path.alias("path"), s.alias("s"), t.alias("t"), rel.alias("rel")).alias("key"))
    return (
        of(nodes, "node", F.col("id"), none, none, none, none)
        .unionByName(of(nodes.where("path IS NOT NULL"), "file", none, F.col("path"), none, none, none))
        .unionByName(of(usage(edges), "edge", none, none, F.col("s"), F.col("t"), F.col("rel")))
    )


def history(builds: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """What every build adds to the one before it and removes from it: (corpus, before, build, what, id, path, s, t, rel, change),
    for nodes(corpus, build, id, path) and edges(corpus, build, s, t, rel) of all builds.

    One pass for all pairs: the builds that hold a thing are looked at in order, and where a run of them begins or ends, but
    for the first and the last build of all, it was added or removed. A thing's rows are as many as its builds, so no key
    is hot, and builds that are alike cost no comparison of two whole ones. Rows of builds that are not in ``builds`` are
    left out; repeated rows count once; a null key field is a value like any other.
    """
    links = F.broadcast(chain(builds))
    held = _things(nodes, edges).distinct().join(links.select("corpus", "build", "no", "last"), ["corpus", "build"])
    at = Window.partitionBy("corpus", "what", "key").orderBy("no")
    held = held.select("corpus", "what", "key", "no", "last", F.lag("no").over(at).alias("prior"), F.lead("no").over(at).alias("next"))
    begins = (F.col("no") > 1) & (F.col("prior").isNull() | (F.col("prior") < F.col("no") - 1))
    ends = (F.col("no") < F.col("last")) & (F.col("next").isNull() | (F.col("next") > F.col("no") + 1))
    found = F.array_compact(F.array(
        F.when(begins, F.struct(F.col("no").alias("no"), F.lit("added").alias("change"))), F.when(ends, F.struct((F.col("no") + 1).alias("no"), F.lit("removed").alias("change"))),
    ))
    held = held.select("corpus", "what", "key", F.explode(found).alias("x")).select("corpus", "what", "key.*", "x.*")
    return held.join(links.select("corpus", "no", "build", "before"), ["corpus", "no"]).select("corpus", "before", "build", "what", "id", "path", "s", "t", "rel", "change")


def summary(changes: DataFrame, builds: DataFrame) -> DataFrame:
    """(corpus, before, build, what, added, removed) of every build after the first, zeros where nothing of a kind changed."""
    links = chain(builds).where("no > 1").select("corpus", "before", "build", F.explode(F.array(*map(F.lit, ("node", "file", "edge")))).alias("what"))
    counted = changes.groupBy("corpus", "build", "what").agg(F.count_if(F.col("change") == "added").alias("added"), F.count_if(F.col("change") == "removed").alias("removed"))
    return links.join(counted, ["corpus", "build", "what"], "left").select("corpus", "before", "build", "what", F.coalesce("added", F.lit(0)).cast("long").alias("added"), F.coalesce("removed", F.lit(0)).cast("long").alias("removed"))
