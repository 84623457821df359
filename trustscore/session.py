"""Session helpers shared by tests, the bench and standalone jobs."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(app: str = "trustscore", cores: str = "*", shuffle_partitions: int = 16) -> SparkSession:
    """A local session with the settings the library relies on (UTC days, AQE with skew handling)."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.files.maxPartitionBytes", "4m")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    if not spark.conf.get("spark.checkpoint.dir", None) and not spark.sparkContext.getCheckpointDir():
        # One machine only: any folder of it is shared by driver and executors.
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="trustscore-"))
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The cluster's shared folder for checkpoints and intermediate tables.

    It is the session's ``spark.checkpoint.dir``, or the checkpoint folder its owner gave the context. Without one
    this is an error: a machine-local folder would not survive the loss of an executor.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
    return folder


def materialized(rows: DataFrame, name: str) -> DataFrame:
    """Write a shared intermediate result once and read it back, so that several branches can scan it.

    The table outlives lost executors, and each branch reads only the columns it needs.
    """
    spark = rows.sparkSession
    path = f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    rows.write.mode("errorifexists").parquet(path)
    return spark.read.schema(rows.schema).parquet(path)
