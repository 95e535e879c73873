"""What an operator needs to know of the cluster it runs on."""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyspark.sql import SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, from ``spark.checkpoint.dir``.

    Where the cluster names none (unit tests, a laptop) a folder of this machine
    is set, which is right there because all executors are on this machine.
    """
    where = spark.conf.get("spark.checkpoint.dir", None) or _context_dir(spark)
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        where = tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", where) if spark.conf.isModifiable("spark.checkpoint.dir") else None
    if not _context_dir(spark):
        spark.sparkContext.setCheckpointDir(where)
    return where


def _context_dir(spark: SparkSession) -> str | None:
    option = spark.sparkContext._jsc.sc().getCheckpointDir()
    return option.get() if option.isDefined() else None


def scratch() -> str:
    """Inside a task: the folder that Spark gave this executor to spill to; empty where it named none."""
    for name in ("LOCAL_DIRS", "SPARK_EXECUTOR_DIRS", "SPARK_LOCAL_DIRS"):
        if os.environ.get(name):
            return re.split("[,:]" if name == "SPARK_EXECUTOR_DIRS" else ",", os.environ[name])[0]
    return ""


def fresh_path(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def buckets(rows: int, per_bucket: int, least: int = 1) -> int:
    """How many groups ``rows`` rows make at about ``per_bucket`` rows each."""
    return max(least, -(-rows // per_bucket))
