"""Session settings and the shared working folder."""

from __future__ import annotations

import gc
import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def build(master: str | None = None, **extra: str) -> SparkSession:
    """A session with the engine's settings; ``extra`` overrides them."""
    builder = SparkSession.builder.appName("framequarry")
    if master:
        builder = builder.master(master)
    return builder.config(map={**SETTINGS, **extra}).getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor sees: ``spark.checkpoint.dir``.

    Where the session names none, a folder of this machine is taken and put into the session, in local mode only: on a
    cluster each executor would write to its own disk.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        master = spark.conf.get("spark.master", "")
        if not master.partition("[")[0] == "local":
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = f"file://{os.path.join(tempfile.gettempdir(), 'framequarry-shared')}"
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def work_dir(spark: SparkSession) -> str:
    """This application's folder of intermediate tables."""
    return f"{shared_dir(spark)}/framequarry/{spark.sparkContext.applicationId}"


def clear(spark: SparkSession) -> None:
    """Delete all intermediate tables of this application; results that read them must have been written before."""
    _delete(spark, work_dir(spark))


def _delete(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder as Parquet and read it again.

    Cuts the lineage: a lost executor costs the tasks it ran, not what came before the written table. The shuffle files
    behind the table aren't needed any more; Spark's cleaner removes them once the driver's garbage is collected.
    """
    spark, schema = df.sparkSession, df.schema
    path = f"{work_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    del df
    gc.collect()
    spark._jvm.java.lang.System.gc()
    out = spark.read.schema(schema).parquet(path)
    out.written_to = path
    return out


def discard(table: DataFrame) -> None:
    """Delete the files of a materialised table that nothing will read again."""
    _delete(table.sparkSession, table.written_to)


def spread(df: DataFrame) -> DataFrame:
    """``df`` in as many partitions as there are cores, if it has fewer: a small file would keep one core busy."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df
