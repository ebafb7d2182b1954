"""Session settings and the shared scratch folder."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import SparkSession

#: Temporary folders of sessions of one process, by application.
_own: dict[str, str] = {}


def build_session(app: str = "usagelens", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the operators rely on.

    Only the UTC time zone is needed for right results.  The adaptive settings let Spark size
    shuffle partitions and split skewed join partitions at run time.
    """
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    }
    settings.update({k.replace("__", "."): v for k, v in conf.items()})
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession, purpose: str) -> str:
    """A fresh folder under ``spark.checkpoint.dir``, the folder that driver and executors share.

    Without the setting a session of one process gets a temporary folder, as in tests; on a cluster it is an
    error, since each machine would write a folder of its own.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or _own.get(spark.sparkContext.applicationId)
    if not root:
        if spark.sparkContext.master != "local" and not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        # The setting cannot be changed once a session runs.
        root = _own[spark.sparkContext.applicationId] = tempfile.mkdtemp(prefix="usagelens-")
    return os.path.join(root, f"{purpose}-{uuid.uuid4().hex}")
