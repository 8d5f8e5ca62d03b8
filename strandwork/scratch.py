"""Tables written in between, in the folder that the cluster names in spark.checkpoint.dir."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir. Where none is named, as in tests, a temporary one, but only if driver and
    executors are one process."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        master = spark.conf.get("spark.master", "local")
        if not (master == "local" or master.startswith("local[")):
            raise ValueError("spark.checkpoint.dir has to name a folder that driver and executors share")
        folder = tempfile.mkdtemp(prefix="strandwork-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def _filesystem(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    place = jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), place


def written(df: DataFrame) -> tuple[DataFrame, str]:
    """df as a Parquet table in the shared folder, and its path. This cuts the lineage: a lost executor costs no more
    than its running tasks. The table goes with the session, or earlier by drop()."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/scratch-{uuid.uuid4().hex}"
    df.write.parquet(path)
    fs, place = _filesystem(spark, path)
    fs.deleteOnExit(place)
    return spark.read.schema(df.schema).parquet(path), path


def drop(spark: SparkSession, *paths: str) -> None:
    for path in paths:
        fs, place = _filesystem(spark, path)
        fs.delete(place, True)
