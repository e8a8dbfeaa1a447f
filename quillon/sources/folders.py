"""Where tables that nobody named a place for are written."""

from __future__ import annotations

import tempfile

from pyspark.sql import SparkSession

from ..errors import EngineError


def shared_base(spark: SparkSession) -> str:
    """The folder that driver and executors share, from spark.checkpoint.dir. Only where everything runs in one process, on one machine,
    does a temporary folder stand in for it; on a cluster each executor would write to a disk of its own, and rows would go missing."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base.rstrip("/")
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise EngineError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return "file://" + tempfile.gettempdir()


def scratch(spark: SparkSession) -> str:
    return shared_base(spark) + "/quillon"
