"""Session construction and the shared work folder.

Iterative operators cut lineage by writing to the folder the cluster names in
``spark.checkpoint.dir``.  On a cluster that folder is shared storage set by
the operator of the cluster; only when it is unset (tests, local runs) do we
pick a local folder ourselves.
"""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid

from pyspark.sql import SparkSession


def build_session(master: str = "local[*]", shuffle_partitions: int = 8,
                  app: str = "harrow") -> SparkSession:
    """A session with the settings the operators assume.

    AQE re-plans joins from runtime sizes (so a side is broadcast only when
    its measured size is under the threshold) and splits skewed partitions
    in sort-merge joins; the session time zone is UTC because stored
    timestamps are compared by their UTC day.
    """
    spark = (
        SparkSession.builder.master(master).appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", os.environ.get("HARROW_DRIVER_MEMORY", "16g"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def work_dir(spark: SparkSession) -> str:
    """The shared folder for checkpoints and written intermediate tables.

    Read from the session first (``spark.checkpoint.dir`` or a checkpoint dir
    already set on the context); only when neither is set, choose a local one,
    which is right for tests and single-machine runs only.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    conf_dir = sc.getConf().get("spark.checkpoint.dir", None)
    if not conf_dir:
        try:
            conf_dir = spark.conf.get("spark.checkpoint.dir")
        except Exception:  # noqa: BLE001 - unset key raises on some versions
            conf_dir = None
    if not conf_dir:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        conf_dir = tempfile.mkdtemp(prefix="harrow-ckpt-")
        atexit.register(shutil.rmtree, conf_dir, ignore_errors=True)  # ours alone, so ours to remove
    sc.setCheckpointDir(conf_dir)
    return sc.getCheckpointDir() or conf_dir


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh, unique path under the shared work folder."""
    base = work_dir(spark).rstrip("/")
    return f"{base}/harrow-{name}-{uuid.uuid4().hex}"
