"""Intermediate tables in the folder that all executors share.

A plan that is read more than once, or that would carry a long lineage, is written once as Parquet and read back.
Unlike cached blocks, such a table outlives the executor that wrote it.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_KEY = "spark.checkpoint.dir"
_registered: set[str] = set()


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``. Only where that is unset (tests, a single machine) a local one is made."""
    configured = spark.conf.get(CHECKPOINT_KEY, None)
    if not configured:
        configured = spark.sparkContext.getConf().get(CHECKPOINT_KEY, None)
    if not configured:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError(f"{CHECKPOINT_KEY} must name a folder that all executors share")
        configured = "file://" + tempfile.mkdtemp(prefix="leafmill-")
        spark.conf.set(CHECKPOINT_KEY, configured)
    return configured.rstrip("/")


def _application_dir(spark: SparkSession) -> str:
    """This application's own folder below the shared one; it goes when the application ends."""
    path = f"{shared_dir(spark)}/leafmill-{spark.sparkContext.applicationId}"
    if path not in _registered:
        folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        system = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        system.mkdirs(folder)
        system.deleteOnExit(folder)
        _registered.add(path)
    return path


def materialize(df: DataFrame, label: str, partition_by: list[str] | None = None) -> DataFrame:
    """Write ``df`` to a table of its own in the shared folder and read it back, which cuts its lineage."""
    spark = df.sparkSession
    path = f"{_application_dir(spark)}/{label}-{uuid.uuid4().hex}"
    writer = df.write.option("compression", "zstd")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
