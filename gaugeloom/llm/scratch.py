"""Tables that cut lineage, in the folder which driver and executors share."""

from __future__ import annotations

import atexit
import gc
import tempfile
import time
import uuid

from pyspark.sql import DataFrame, SparkSession

_written: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The session's ``spark.checkpoint.dir``; a temporary folder only where that is unset and Spark is local."""
    conf = spark.sparkContext.getConf()
    found = conf.get("spark.checkpoint.dir")
    if found:
        return found.rstrip("/")
    if not conf.get("spark.master", "").startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder which all executors share")
    return f"{tempfile.gettempdir()}/gaugeloom-{spark.sparkContext.applicationId}"


def save(df: DataFrame) -> DataFrame:
    """Write ``df`` once to the shared folder and return it as read from there."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _written.append((spark, path))
    out = spark.read.schema(df.schema).parquet(path)
    out.scratch_path = path
    return out


def drop(df: DataFrame) -> None:
    """Delete a table of :func:`save` which nothing reads any more."""
    path = getattr(df, "scratch_path", None)
    if path:
        _delete(df.sparkSession, path)


def free(spark: SparkSession) -> None:
    """Let Spark's cleaner take the shuffle files of plans that no one holds any more, which it else does when the driver's memory fills."""
    for _ in range(2):  # the first lets Python's handles go
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.3)


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


@atexit.register
def _clean() -> None:
    for spark, path in _written:
        try:
            _delete(spark, path)
        except Exception:  # the session has ended; the folder is the cluster's to empty
            return
