"""Session helpers shared by bench, tests and the entry module."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def local_session(cpus: int | str = "*", shuffle_partitions: int = 8, memory: str = "12g") -> SparkSession:
    """A local session with the settings the engine expects (UTC, AQE, few shuffle partitions)."""
    os.environ.setdefault("SPARK_LOCAL_IP", "127.0.0.1")
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("brindle")
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def checkpoint_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir, which all machines share; in a local session one of our own where that is unset, gone with the process."""
    sc = spark.sparkContext
    if folder := sc.getConf().get("spark.checkpoint.dir"):
        return folder.rstrip("/")
    if not sc.getCheckpointDir():
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="brindle-")
        atexit.register(shutil.rmtree, folder, True)
        sc.setCheckpointDir(folder)
    return sc.getCheckpointDir().rstrip("/")


def delete_folder(spark: SparkSession, path: str) -> None:
    """A folder of the shared file system, whatever it is."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


@contextmanager
def shared_folder(spark: SparkSession, label: str) -> Iterator[str]:
    """A new folder that all machines share, deleted afterwards."""
    path = f"{checkpoint_folder(spark)}/{label}-{uuid.uuid4().hex}"
    try:
        yield path
    finally:
        delete_folder(spark, path)


def settled(df: DataFrame) -> DataFrame:
    """df written once and read back, so that its lineage is short and lost executors cost nothing but the read."""
    path = f"{checkpoint_folder(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
