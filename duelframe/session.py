"""Session settings and lineage cuts."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # Call-site capture on every column expression; wide generated plans pay for it without using it.
    "spark.python.sql.dataFrameDebugging.enabled": "false",
}


def build_session(name: str = "duelframe", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the engine's defaults; on a cluster the submit-time settings win."""
    builder = SparkSession.builder.appName(name)
    if master:
        builder = builder.master(master)
    for key, value in {**DEFAULTS, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def int_setting(spark: SparkSession, key: str, default: int) -> int:
    return int(spark.conf.get(key, str(default)))


_local_folders: dict[str, str] = {}
_kept: set[str] = set()


def app_folder(spark: SparkSession) -> str:
    """This application's own part of the checkpoint folder; it goes when the application ends."""
    folder = f"{checkpoint_dir(spark)}/{spark.sparkContext.applicationId}"
    if folder not in _kept:
        _kept.add(folder)
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(path)
    return folder


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``; a temporary one only in local runs without it."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a shared folder on a cluster")
    app = spark.sparkContext.applicationId
    if app not in _local_folders:
        _local_folders[app] = tempfile.mkdtemp(prefix="spark-")
    return _local_folders[app]


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a Parquet table in the shared checkpoint folder and read it back.

    Used where a wide stage feeds more than one branch or query: it runs once, later scans
    prune columns, and a lost executor costs a re-read instead of a recomputation.
    """
    spark = df.sparkSession
    path = f"{app_folder(spark)}/{name}-{uuid.uuid4().hex[:8]}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)
