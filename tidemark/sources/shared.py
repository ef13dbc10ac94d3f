"""The folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession


def shared_path(spark: SparkSession, what: str) -> str:
    """A new folder name inside the folder that driver and executors share (spark.checkpoint.dir).

    Where the session names none, a temporary folder is set for this session,
    on one machine only: elsewhere it wouldn't be shared, and that is an error.
    """
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if not named and sc.getCheckpointDir() is None:
        if not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="spark-shared-"))
    return f"{(named or sc.getCheckpointDir()).rstrip('/')}/{what}-{uuid.uuid4().hex}"
