"""Session-level helpers: table access and lineage cutting."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The cluster's checkpoint folder; a temporary one only for local masters where none is configured."""
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="biblioflux-ckpt-")
    sc.setCheckpointDir(folder)
    return sc.getCheckpointDir()


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut lineage through the shared folder, so that a lost executor costs no recomputation of the loop."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def own_folder(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, which the driver removes at its end (results that are read lazily need it until then)."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    # only paths that exist are registered
    fs.mkdirs(at)
    fs.deleteOnExit(at)
    return path


def written(df: DataFrame) -> DataFrame:
    """Like checkpointed, as a compressed table in the shared folder: for rows with long texts, which a checkpoint keeps uncompressed."""
    path = own_folder(df.sparkSession, "kept")
    df.write.mode("append").option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
