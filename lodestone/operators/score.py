"""Precision and recall of extracted links against known ones."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CODE = r"\.(py|jsx?)$"


def in_scope(truth: DataFrame, ours: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Known links of code files, and ours in those files; both with source_file."""
    truth = truth.where(F.col("source_file").rlike(CODE))
    return truth, ours.join(truth.select("corpus", "source_file").distinct(), ["corpus", "source_file"], "left_semi")


def relation_scores(truth: DataFrame, ours: DataFrame) -> DataFrame:
    """Recall and precision by relation and in all (relation 'TOTAL'), by source, target and relation."""
    keys = ["corpus", "s", "t", "rel"]
    a, b = truth.select(*keys).distinct().withColumn("known", F.lit(1)), ours.select(*keys).distinct().withColumn("ours", F.lit(1))
    met = a.join(b, keys, "full")
    both = F.sum(F.when(F.col("known").isNotNull() & F.col("ours").isNotNull(), 1).otherwise(0)).alias("found")
    by = met.rollup("corpus", "rel").agg(F.count("known").alias("truth"), F.count("ours").alias("ours"), both)
    by = by.where("corpus is not null").withColumn("rel", F.coalesce("rel", F.lit("TOTAL")))
    return by.select(
        "corpus", "rel", "truth", "ours", "found",
        F.round(F.when(F.col("truth") > 0, F.col("found") / F.col("truth")), 6).alias("recall"),
        F.round(F.when(F.col("ours") > 0, F.col("found") / F.col("ours")), 6).alias("precision"),
    )


def entity_recall(truth: DataFrame, ours: DataFrame) -> DataFrame:
    """Known names of each file that were found: (corpus, path, name) on both sides."""
    keys = ["corpus", "path", "name"]
    mine = ours.select(*keys).distinct().withColumn("hit", F.lit(1))
    return truth.select(*keys).distinct().join(mine, keys, "left").groupBy("corpus").agg(F.count("*").alias("truth"), F.count("hit").alias("found"))
