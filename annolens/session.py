"""Session helpers.

The library never builds its own session inside an operator: every
function takes a DataFrame or a SparkSession.  ``build_session`` is for
tests, the bench and command-line use.
"""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import SparkSession

DEFAULT_CONF = {
    "spark.ui.enabled": "false",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # Text rows are large (whole documents): smaller Arrow batches for UDFs.
    "spark.sql.execution.arrow.maxRecordsPerBatch": "2000",
    # A model stage must not run twice for the same rows.
    "spark.speculation": "false",
    # Checkpoint files of distill rounds are removed once unreferenced.
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
}


def build_session(master: str | None = None, shuffle_partitions: int | None = None,
                  app_name: str = "annolens", extra: dict | None = None) -> SparkSession:
    """A session.  What is not given is left to ``spark-submit`` and the configuration."""
    builder = SparkSession.builder.appName(app_name)
    conf = dict(DEFAULT_CONF)
    if master:
        builder = builder.master(master)
    if master and master.startswith("local"):
        conf["spark.driver.memory"] = os.environ.get("ANNOLENS_DRIVER_MEMORY", "8g")
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
    """Return the shared checkpoint folder named by ``spark.checkpoint.dir``.

    On a cluster the setting names a shared file system and is used as is.
    Only when it is unset on a local master (unit tests, a laptop) a private
    folder is made; on a cluster that would be a folder of the driver's machine,
    so it is an error.
    """
    try:
        sc = spark.sparkContext
    except Exception:  # noqa: BLE001 - Spark Connect has no SparkContext
        sc = None
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path and sc is not None:
        path = sc.getConf().get("spark.checkpoint.dir", None)
    if not path and sc is not None and (sc.master.startswith("local-cluster") or not sc.master.startswith("local")):
        raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
    if not path:
        path = tempfile.mkdtemp(prefix="annolens-ckpt-")
        spark.conf.set("spark.checkpoint.dir", path)
    if sc is not None and sc.getCheckpointDir() is None:
        sc.setCheckpointDir(path)
    return path


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh table location below the shared checkpoint folder."""
    base = ensure_checkpoint_dir(spark).rstrip("/")
    return f"{base}/annolens/{name}-{uuid.uuid4().hex[:12]}"

