"""Session settings shared by the entry file, the benchmark and the tests."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int | None = None, memory: str = "12g") -> SparkSession:
    """A local session for tests and the benchmark. On a cluster, pass your own session."""
    cores = cores or os.cpu_count() or 2
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("tablewise")
        .config("spark.sql.shuffle.partitions", str(cores))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder every machine can write to, from ``spark.checkpoint.dir``.

    A local session without that setting gets a scratch folder; a cluster without
    it is an error, because a machine-local folder dies with its executor.
    """
    sc = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if folder:
        return folder
    if not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a shared folder")
    spark.conf.set("spark.checkpoint.dir", tempfile.mkdtemp(prefix="run-"))  # one folder for the whole session
    return spark.conf.get("spark.checkpoint.dir")


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint in the shared folder."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)
