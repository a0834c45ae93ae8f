"""Session construction and the one place where lineage is cut."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


#: Beneath the default file system, where spark.checkpoint.dir is not set.
DEFAULT_FOLDER = "/tmp/riskfabric-checkpoints"


def build_session(app: str = "riskfabric", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings every job here relies on.

    Shuffle width is left to AQE: a wide initial partition count that is coalesced at run time, so the
    same setting serves a laptop and a cluster.
    """
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
    }
    settings.update(conf)
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; without the setting a folder of the default file system, by the same rule on every master.

    A folder that only one machine sees is refused unless the master is local.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    folder = spark.conf.get("spark.checkpoint.dir", None) or f"{sc._jsc.hadoopConfiguration().get('fs.defaultFS').rstrip('/')}{DEFAULT_FOLDER}"
    if folder.startswith("file:") and not spark.conf.get("spark.checkpoint.dir", None) and not sc.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder every executor can reach")
    sc.setCheckpointDir(folder)
    return sc.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """Materialise to the reliable checkpoint folder; survives executor loss and keeps partitioning."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh folder beneath the checkpoint folder, for outputs that are read back in the same job."""
    return f"{ensure_checkpoint_dir(spark)}/riskfabric/{name}-{uuid.uuid4().hex}"


def discard(spark: SparkSession, folder: str) -> None:
    """Removes a folder that `scratch` named, once nothing reads it any more."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
