"""Tables written to the shared folder to cut lineage.

The folder is ``spark.checkpoint.dir``, which every executor of a cluster can read. Only where that setting is absent and driver
and executors are one process (tests, a laptop) a temporary folder of the driver serves instead.
"""

from __future__ import annotations

import atexit
import math
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

SETTING = "spark.checkpoint.dir"
#: Bytes of one bucket, about; Spark's own limit of buckets; sizes from here on mean that Spark knows none.
BUCKET_BYTES, MOST_BUCKETS, UNKNOWN = 128 << 20, 100_000, 1 << 60
_own: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    folder = spark.conf.get(SETTING, None)
    if not folder:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise RuntimeError(f"set {SETTING} to a folder that the driver and all executors share")
        application = spark.sparkContext.applicationId
        if application not in _own:
            _own[application] = "file://" + tempfile.mkdtemp(prefix="tidepool-")
        folder = _own[application]
    return folder.rstrip("/")


def _remove(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
    except Exception:  # the session may have ended; the folder is scratch space anyway
        pass


def scratch_path(spark: SparkSession, label: str) -> str:
    """A new folder under the shared one, removed when the driver's Python ends."""
    path = f"{shared_folder(spark)}/tidepool/{label}-{uuid.uuid4().hex}"
    atexit.register(_remove, spark, path)
    return path


def cut(frame: DataFrame, label: str) -> DataFrame:
    """Write ``frame`` as Parquet and read it back: later steps start from the files, whichever executors are lost."""
    spark = frame.sparkSession
    path = scratch_path(spark, label)
    frame.write.parquet(path)
    return spark.read.schema(frame.schema).parquet(path)


def bucket_count(frame: DataFrame, each: int = BUCKET_BYTES) -> int:
    """As many as shuffles have partitions, and enough that none is far above ``each`` bytes by what Spark knows of the input's size."""
    least = int(frame.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    size = int(frame._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return max(least, min(math.ceil(size / each), MOST_BUCKETS)) if size < UNKNOWN else least


def _drop(spark: SparkSession, name: str) -> None:
    try:
        spark.sql(f"DROP TABLE IF EXISTS {name}")
    except Exception:  # the session may have ended, and its catalog with it
        pass


def cut_bucketed(frame: DataFrame, label: str, keys: list[str], buckets: int | None = None) -> DataFrame:
    """As ``cut``, hash-bucketed by ``keys`` so that joins on them need no shuffle of this side. The table goes when the driver's Python ends."""
    spark = frame.sparkSession
    name = f"{label}_{uuid.uuid4().hex}"
    writer = frame.write.bucketBy(buckets or bucket_count(frame), *keys).option("path", scratch_path(spark, label))
    writer.format("parquet").saveAsTable(name)
    atexit.register(_drop, spark, name)
    return spark.table(name)
