"""Session defaults and the shared scratch folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession


def build_session(app: str = "pavesa", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings every job relies on: UTC clock and adaptive execution."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        # Geometry costs far more per byte than a plain scan, so small partitions stay apart.
        "spark.sql.adaptive.coalescePartitions.minPartitionSize": "128k",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        **conf,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder, from ``spark.checkpoint.dir``.

    Only a local-mode session (tests, bench) may fall back to a folder of this machine.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get(
        "spark.checkpoint.dir", None
    )
    if configured:
        return configured
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
    existing = getattr(spark, "_pavesa_scratch", None)
    if existing is None:
        existing = tempfile.mkdtemp(prefix="run-")
        spark._pavesa_scratch = existing
    return existing


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path under the shared folder; nothing is ever overwritten."""
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex[:12]}"


def cut_lineage(df, label: str):
    """Reliable cut: write to the shared folder and read back, so a lost executor replays nothing."""
    spark = df.sparkSession
    path = scratch_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(spark: SparkSession, path: str) -> None:
    """Remove a table of ``scratch_path`` that nothing reads any more."""
    if not path.startswith(shared_dir(spark)):
        raise ValueError(f"{path} is not in the scratch folder")
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
