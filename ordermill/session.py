"""A session with the settings that the queries' results rely on."""

from __future__ import annotations

import atexit
import contextlib
import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(name: str = "ordermill", master: str | None = None, **conf: str) -> SparkSession:
    """UTC and ANSI are semantics; the rest is adaptive, so that partitions follow the data."""
    builder = SparkSession.builder.appName(name)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.ansi.enabled": "true",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
    }
    for key, value in (settings | conf).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def cut(df: DataFrame) -> DataFrame:
    """df without its lineage, computed now: in the folder of spark.checkpoint.dir, or persisted where none is set."""
    if df.sparkSession.sparkContext.getCheckpointDir() is not None:
        return df.checkpoint()
    return df.persist()


def shared_folder(spark: SparkSession) -> str:
    """A folder that driver and executors share: that of spark.checkpoint.dir, or else the warehouse."""
    return spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.sql.warehouse.dir")


def own_folder(spark: SparkSession, name: str) -> str:
    """A new folder in the shared one, which goes when the process ends."""
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"

    def remove() -> None:
        with contextlib.suppress(Exception):  # the session may have ended already; the folder is the cluster's to clean
            jvm = spark.sparkContext._jvm
            target = jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)

    atexit.register(remove)
    return path
