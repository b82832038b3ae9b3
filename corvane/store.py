"""Tables that cut lineage, kept where every executor can read them."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def folder(spark: SparkSession) -> str:
    """The shared folder of the cluster (spark.checkpoint.dir); one of our own only where that is unset and everything runs in one process."""
    given = spark.conf.get("spark.checkpoint.dir", None)
    if not given:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        given = "file://" + tempfile.mkdtemp(prefix="corvane-")
        spark.conf.set("spark.checkpoint.dir", given)
    return given.rstrip("/")


def stored(df: DataFrame, tag: str, compression: str = "snappy") -> DataFrame:
    """Write df as Parquet into the shared folder and read it back, so that a lost executor costs no recomputation."""
    spark = df.sparkSession
    path = f"{folder(spark)}/corvane/{tag}-{uuid.uuid4().hex}"
    df.write.option("compression", compression).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop(df: DataFrame) -> None:
    """Delete the files behind a table made by stored(), once nothing reads it any more."""
    spark = df.sparkSession
    hadoop = spark._jvm.org.apache.hadoop.fs.Path
    root = folder(spark)
    for name in {x.rsplit("/", 1)[0] for x in df.inputFiles()}:
        path = hadoop(name)
        if "/corvane/" in name and root.split("://")[-1].lstrip("/") in name:
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def bounded_broadcast(df: DataFrame, megabytes: int) -> DataFrame:
    """Hint a broadcast only if the rows of the stored table, as numbers of 8 bytes, take at most so many megabytes; otherwise the join shuffles."""
    return F.broadcast(df) if df.count() * 8 * max(1, len(df.columns)) <= megabytes << 20 else df
