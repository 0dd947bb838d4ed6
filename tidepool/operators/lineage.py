"""Cutting lineage in loops."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

SETTING = "spark.checkpoint.dir"


def _folder(context) -> None:
    if not context.getCheckpointDir():
        folder = context.getConf().get(SETTING, None)
        if not folder and not re.match(r"local(\[|$)", context.master):
            raise RuntimeError(f"set {SETTING} to a folder that the driver and all executors share")
        context.setCheckpointDir(folder or "file://" + tempfile.mkdtemp(prefix="tidepool-"))


def checkpointed(frame: DataFrame) -> DataFrame:
    """``frame`` written to the folder that ``spark.checkpoint.dir`` names, which all executors share.

    One of our own serves only where it is unset and driver and executors are one process.
    """
    _folder(frame.sparkSession.sparkContext)
    return frame.checkpoint()


def scratch(spark: SparkSession, label: str) -> str:
    """A new path below the same folder."""
    _folder(spark.sparkContext)
    return f"{spark.sparkContext.getCheckpointDir()}/{label}-{uuid.uuid4().hex}"


def written(frame: DataFrame, label: str) -> DataFrame:
    """``frame`` written as Parquet below the same folder and read again: computed once, its size known to what follows."""
    path = scratch(frame.sparkSession, label)
    frame.write.parquet(path)
    return frame.sparkSession.read.schema(frame.schema).parquet(path)
