"""Where iterative plans cut their lineage."""

from __future__ import annotations

import atexit
import gc
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share. Where the session names none, a local master gets a fresh temporary one (tests);
    on a cluster, whose executors would each write to a disk of their own, that is an error."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="lodestone-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def materialize(df: DataFrame, label: str) -> DataFrame:
    """``df`` written as Parquet to the shared folder and read back."""
    path = f"{shared_dir(df.sparkSession)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(*tables: DataFrame) -> None:
    """Delete the files of tables that ``materialize`` wrote and that no further plan reads."""
    for df in tables:
        spark = df.sparkSession
        for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            path = spark._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def release(spark: SparkSession) -> None:
    """Have Spark drop the shuffle files of plans that nothing refers to any more. It does so when the driver collects its garbage,
    which may be long after the next shuffle has been written. Listeners hold on to the query that ended last, so a small one
    ends first."""
    gc.collect()
    spark.range(1).count()
    spark.sparkContext._jvm.System.gc()


def running_sum(df: DataFrame, by: str, order: list[str], value: str, name: str) -> DataFrame:
    """``df`` with ``name``: the sum of ``value`` over the rows of the same ``by`` up to this one in the order given.

    Rows are dealt out by ranges and sorted there; a row's sum is that within its part and the totals of the parts before
    it. So no task holds all rows of a ``by``; what a window sees whole is one total a part.
    """
    ranged = df.repartitionByRange(by, *order).withColumn("__part", F.spark_partition_id())
    ranged = materialize(ranged, "ranged")
    part = Window.partitionBy(by).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    before = ranged.groupBy(by, "__part").agg(F.sum(value).alias("__total"))
    before = before.select(by, "__part", F.coalesce(F.sum("__total").over(part), F.lit(0)).alias("__before"))
    within = Window.partitionBy(by, "__part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    summed = ranged.withColumn(name, F.sum(value).over(within))
    return summed.join(F.broadcast(before), [by, "__part"]).withColumn(name, F.col(name) + F.col("__before")).drop("__part", "__before")
