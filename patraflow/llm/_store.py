"""Tables written in the shared folder of the session, to cut lineage so that lost executors cost one step only."""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, which all executors must share. Without that setting a cluster has none, and an
    error says so."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not path and spark.sparkContext.master.startswith("local["):
        path = tempfile.mkdtemp(prefix="patraflow-")  # tests: driver and executor are one process
        spark.conf.set("spark.checkpoint.dir", path)
    if not path:
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return path.rstrip("/")


def folder(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"


def save(df: DataFrame, name: str) -> DataFrame:
    """Writes df as Parquet in the shared folder and reads it again."""
    path = folder(df.sparkSession, name)
    df.write.mode("overwrite").parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._patraflow_path = path
    return out


def drop(*saved: DataFrame) -> None:
    """Deletes tables of save() that no later step reads, and lets Spark drop shuffle files."""
    for df in saved:
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df._patraflow_path)
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)
    if saved:
        release(saved[0].sparkSession)


def release(spark: SparkSession) -> None:
    """Lets Spark drop the shuffle files of steps whose results are saved; it does so when the driver collects its garbage."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()
