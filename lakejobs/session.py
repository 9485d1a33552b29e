"""Session helper, scratch folder and table loading."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def get_session(app_name: str = "lakejobs", **conf: str) -> SparkSession:
    """Get or create a session. The master comes from the submit command.

    ``conf`` keys use ``__`` for the dots, e.g. ``spark__sql__shuffle__partitions``.
    """
    builder = SparkSession.builder.appName(app_name)
    builder = builder.config("spark.sql.session.timeZone", "UTC")
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def scratch_dir(spark: SparkSession, label: str) -> str:
    """A new folder name for tables that a job writes and reads back.

    It lies under ``spark.checkpoint.dir``, which every executor can reach. Only
    a local session without that setting falls back to a temporary folder.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.conf.get("spark.master", "").startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
        root = tempfile.mkdtemp(prefix="run-", dir="/tmp")
    return f"{root.rstrip('/')}/lakejobs/{label}-{uuid.uuid4().hex}"


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given Parquet tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
