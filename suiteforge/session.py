"""Session helpers: table loading, lineage cuts and a local session for tests.

Library functions never change session settings.  The only exception is the
checkpoint directory, which is set only when the cluster has not named one
(``spark.checkpoint.dir``), as in local tests.
"""

from __future__ import annotations

import os
import re
import tempfile

from pyspark.sql import DataFrame, SparkSession

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Read one driver table; Catalyst prunes columns and pushes filters into the scan."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, app: str = "suiteforge") -> SparkSession:
    """A local session configured like the tests and the benchmark."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .config("spark.driver.memory", os.environ.get("SUITEFORGE_DRIVER_MEMORY", "16g"))
    )
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def checkpoint_dir(spark: SparkSession) -> str | None:
    """The checkpoint directory the cluster names, if any."""
    opt = spark.sparkContext._jsc.sc().getCheckpointDir()
    if opt.isDefined():
        return opt.get()
    conf = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    return conf or None


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint directory; set one only when none is defined.

    A directory the context already uses is left alone (setting it again
    would nest a fresh sub-folder on every call).  The ``spark.checkpoint.dir``
    setting is used when present; a scratch folder is made only where the
    session names none and runs in one process (local tests), and any other
    session without the setting is an error.
    """
    sc = spark.sparkContext
    opt = sc._jsc.sc().getCheckpointDir()
    if opt.isDefined():
        return opt.get()
    d = sc.getConf().get("spark.checkpoint.dir", None)
    if not d:
        if not re.fullmatch(r"local(\[[^\]]*\])?", sc.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        d = tempfile.mkdtemp(prefix="suiteforge-ckpt-", dir="/tmp")  # one process, one disk
    sc.setCheckpointDir(d)
    return sc._jsc.sc().getCheckpointDir().get()


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint in the shared checkpoint folder (survives executor loss)."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)
