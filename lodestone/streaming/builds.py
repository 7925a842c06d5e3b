"""Builds that keep arriving: a stream of saved builds into the retained table, and a running view of a change log."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from ..operators.history import eviction, upsert

BUILD = "id string, name string, saved_at timestamp, bytes long"


def retain(stream: DataFrame, folder: str, checkpoint: str) -> DataStreamWriter:
    """Each micro-batch of builds (columns of BUILD) is merged into ``folder``/<batch>, with what retention dooms left
    out; the latest batch folder is the table. A batch that runs again writes the same folder again."""

    def step(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        # The table that this batch starts from is that of the batch before, whether or not this one ran already.
        latest = _latest(spark, folder, number)
        table = batch if latest is None else upsert(latest, batch)
        kept = eviction(table.dropDuplicates(["id"])).where(~F.col("doomed")).select("id", "name", "saved_at", "bytes")
        kept.write.mode("overwrite").parquet(f"{folder}/batch={number}")

    return stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint)


def _latest(spark, folder: str, before: int) -> DataFrame | None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    files = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not files.exists(path):
        return None
    numbers = [int(s.getPath().getName().split("=")[1]) for s in files.listStatus(path) if s.getPath().getName().startswith("batch=")]
    earlier = [n for n in numbers if n < before]
    return spark.read.schema(BUILD).parquet(f"{folder}/batch={max(earlier)}") if earlier else None


def current(spark, folder: str) -> DataFrame:
    """The retained builds."""
    found = _latest(spark, folder, 1 << 62)
    return spark.createDataFrame([], BUILD) if found is None else found


def activity(log: DataFrame, size: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Queries and file views by corpus and window of event time, from log(corpus, at timestamp): works on a stream,
    where rows later than ``late`` no longer count, and on a table alike."""
    return log.withWatermark("at", late).groupBy("corpus", F.window("at", size)).agg(F.count("*").alias("n"))
