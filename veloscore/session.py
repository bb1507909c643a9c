"""Session helpers: a local session for tests/bench and the shared scratch location."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession

#: Settings every session built here gets. AQE re-plans shuffles at runtime; UTC keeps any
#: timestamp_ntz -> timestamp cast deterministic (the library itself never depends on it).
DEFAULT_CONF = {
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def local_session(cpus: int | str = "*", shuffle_partitions: int = 8, app: str = "veloscore",
                  extra: dict[str, str] | None = None) -> SparkSession:
    """A local session configured like the tests and the bench expect."""
    builder = SparkSession.builder.master(f"local[{cpus}]").appName(app)
    conf = dict(DEFAULT_CONF)
    conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder the cluster names for checkpoints.

    Read from the session (``SparkContext.getCheckpointDir`` or ``spark.checkpoint.dir``). Only
    when neither is set in local mode (a bare test session) is a private folder created and
    registered; on a cluster, where executors would not see it, that is an error.
    """
    sc = spark.sparkContext
    root = sc.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="veloscore-ckpt-"))
        root = sc.getCheckpointDir()
    return root.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh, never reused path under the shared checkpoint folder.

    Files written here must outlive the lazy DataFrame that reads them back, so nothing is
    deleted by this module.
    """
    return f"{checkpoint_root(spark)}/veloscore-scratch/{name}-{uuid.uuid4().hex}"
