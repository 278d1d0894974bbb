"""Intermediate tables: written to the folder that all executors share and read again, which cuts the lineage and survives lost executors."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir. A local session without one gets its own temporary folder; a cluster must name one."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        master = spark.conf.get("spark.master", "")
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="spark-", dir=os.environ.get("TMPDIR"))
        delete_at_end(spark, found)
        spark.conf.set("spark.checkpoint.dir", found)
    return found


def delete_at_end(spark: SparkSession, path: str) -> None:
    """Delete path when the driver's JVM ends."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(folder)


def stored(df: DataFrame, what: str) -> DataFrame:
    """Write df to the shared folder and read it again; the table goes when the driver ends."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/quarry-{what}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    delete_at_end(spark, path)
    return spark.read.schema(df.schema).parquet(path)


def is_there(df: DataFrame) -> bool:
    """Whether the files of a stored table still exist."""
    spark, names = df.sparkSession, df.inputFiles()
    paths = [spark._jvm.org.apache.hadoop.fs.Path(n) for n in names]
    return bool(paths) and all(p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p) for p in paths)
