"""Session helpers: a local session for tests and the checkpoint folder."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession


def local_session(cpus: int | str = "*", app: str = "riskloom",
                  shuffle_partitions: int = 8) -> SparkSession:
    """Session for tests and the bench. On a cluster use the cluster's own."""
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("RISKLOOM_DRIVER_MEMORY", "8g"))
    )
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder named by ``spark.checkpoint.dir``.

    On a cluster the setting names a shared file system folder and is left
    alone; without it an error is raised. Only in local mode (tests, one
    machine) a scratch folder is made when it is unset.
    """
    current = spark.conf.get("spark.checkpoint.dir", None)
    known = spark.sparkContext._jsc.sc().getCheckpointDir()
    known = known.get() if known.isDefined() else None
    current = current or known
    if not current:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        current = tempfile.mkdtemp(prefix="riskloom-ckpt-")
        spark.conf.set("spark.checkpoint.dir", current)
    if known is None:  # each call would make another folder below it
        spark.sparkContext.setCheckpointDir(current)
    return current
