"""Spark session construction and the shared checkpoint folder.

The library never creates its own session inside an operator; callers pass one
in.  ``get_spark`` is a convenience for tests, benchmarks and the pipeline.
"""
from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Session settings every job relies on: AQE re-plans shuffles at runtime
# (coalesces small partitions, splits skewed join partitions, turns a join into
# a broadcast only when the *measured* side is small), and the UI stays off.
DEFAULT_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "4",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "64m",
    "spark.sql.files.maxPartitionBytes": "128m",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.ui.enabled": "false",
    # local mode only (the driver JVM is the executor); a cluster sets its own
    "spark.driver.memory": "16g",
    "spark.ui.showConsoleProgress": "false",
}


def get_spark(master: str | None = None, app: str = "reqlens",
              shuffle_partitions: int | None = None,
              extra: dict[str, str] | None = None) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    conf = dict(DEFAULT_CONF)
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the cluster's shared checkpoint folder (``spark.checkpoint.dir``).

    On a cluster this must be set by whoever launches the job (a shared,
    fault-tolerant file system).  Only a local-mode session without the setting
    (tests, benchmarks) gets a fresh scratch folder of its own.
    """
    sc = spark.sparkContext
    d = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if d:
        if not sc.getCheckpointDir():
            sc.setCheckpointDir(d)
        return d
    if not sc.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a shared folder on a cluster")
    d = tempfile.mkdtemp(prefix="reqlens-ckpt-", dir=os.environ.get("TMPDIR", "/tmp"))
    sc.setCheckpointDir(d)
    spark.conf.set("spark.checkpoint.dir", d)
    return d


def cut_lineage(df: DataFrame, eager: bool = True) -> DataFrame:
    """Reliable checkpoint into the shared folder (survives executor loss)."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=eager)


def store(df: DataFrame, what: str, by: str | None = None) -> str:
    """Write ``df`` as Parquet to the shared folder, with a folder for each value of ``by``; its path."""
    path = f"{ensure_checkpoint_dir(df.sparkSession).rstrip('/')}/{what}-{uuid.uuid4().hex[:12]}"
    (df.write.partitionBy(by) if by else df.write).parquet(path)
    return path


def stored(df: DataFrame, what: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back: cuts the
    lineage like a checkpoint, and later reads take only the columns they need."""
    return df.sparkSession.read.schema(df.schema).parquet(store(df, what))


def drop(df: DataFrame) -> None:
    """Delete what ``stored`` wrote for ``df``, once no plan that reads it is left to run."""
    files, spark = df.inputFiles(), df.sparkSession
    if files:
        folder = spark._jvm.org.apache.hadoop.fs.Path(files[0].rsplit("/", 1)[0])
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def file_system(uri: str):
    """(pyarrow file system, path) of a folder of the shared store, for use inside tasks."""
    from pyarrow import fs
    return fs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else (fs.LocalFileSystem(), uri)
