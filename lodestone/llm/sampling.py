"""Bounded samples of labelled rows, for the models trained here."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows whose crc32(doc_id as text) leaves this remainder are never learned from.
FOLDS, HELD_OUT = 4, 2


def held_out(doc_id="doc_id"):
    """Whether a row is kept from training; false for a null id."""
    fold = F.crc32(F.col(doc_id).cast("string").cast("binary")) % FOLDS
    return F.coalesce(fold == HELD_OUT, F.lit(False))


def labelled_sample(labels: DataFrame, per_class: int, label: str = "quality") -> DataFrame:
    """At most ``per_class`` ids of either label (0 and 1) that may be learned from: doc_id, label, weight.

    The ids are those of least hash, so the sample does not depend on the order of rows. weight is the number of
    labelled rows that a sampled row of its label stands for. An id labelled more than once counts once, by its least
    label, so repeated rows change nothing; null ids and labels are no labels. No labels give no rows.
    """
    known = labels.where(F.col("doc_id").isNotNull() & F.col(label).isin(0, 1) & ~held_out())
    known = known.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min(label).cast("int").alias("label"))
    sizes = {row["label"]: row["count"] for row in known.groupBy("label").count().collect()}
    parts = [
        known.where(F.col("label") == value).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class)
        .withColumn("weight", F.lit(sizes.get(value, 0) / max(1, min(per_class, sizes.get(value, 0)))))
        for value in (0, 1)
    ]
    return parts[0].unionByName(parts[1])
