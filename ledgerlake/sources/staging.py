"""Tables that are written once and read many times, in the folder that the cluster names for checkpoints."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; a single process may do without, a cluster may not, as executors don't see each other's disks."""
    sc = spark.sparkContext
    folder = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not folder:
        if not re.match(r"local(\[|$)", sc.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="spark-")
        sc.setCheckpointDir(folder)
    return folder.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder in the shared one."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def staged(df: DataFrame, name: str) -> DataFrame:
    """df, written as a table and read back, so that its readers neither repeat its work nor depend on one executor."""
    path = scratch(df.sparkSession, name)
    for paths in _passing[-1:]:
        paths.append(path)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: For each passing() that is open, what staged() has written in it.
_passing: list[list[str]] = []
#: Whether Spark removes the shuffle files of a query when it has run.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def passing(spark: SparkSession) -> Iterator[None]:
    """What staged() writes inside is removed at its end, and shuffle files when the query that wrote them has run. No
    DataFrame over them may run later; results that outlive it are collected or staged before or after."""
    before = spark.conf.get(CLEANUP, None)
    _passing.append([])
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(CLEANUP)
        else:
            spark.conf.set(CLEANUP, before)
        for path in _passing.pop():
            remove(spark, path)


def remove(spark: SparkSession, folder: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def placed(df: DataFrame, *order: Column, name: str = "place") -> DataFrame:
    """df with each row's place, from 1, in an order of all rows, which has to tell them apart.

    Rows are dealt to ranges of the order and ranked within each; only the ranges' sizes meet in one task.
    """
    rows = staged(df.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()), "ranges")
    sizes = rows.groupBy("_range").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select("_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    place = F.row_number().over(Window.partitionBy("_range").orderBy(*order)) + F.col("_before")
    return rows.join(F.broadcast(sizes), "_range").withColumn(name, place.cast("long")).drop("_range", "_before")


def drop_staged(spark: SparkSession, df: DataFrame) -> None:
    """Removes the files of a table that staged() returned; nothing that reads it may run later."""
    for folder in {f.rpartition("/")[0] for f in df.inputFiles()}:
        remove(spark, folder)
