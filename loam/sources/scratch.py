"""Intermediate results in the folder that driver and executors share.

A table is deleted when its user says that a later one has taken its place, all others when the driver's Python ends.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid
from contextlib import suppress

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder the session names in ``spark.checkpoint.dir``.

    Where it is unset, a temporary folder is set for a local master only; a cluster without the
    setting is an error, because a machine-local folder would be lost with its machine.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    made = f"file://{tempfile.mkdtemp(prefix='loam-shared-')}"
    spark.sparkContext.setCheckpointDir(made)
    return spark.sparkContext.getCheckpointDir().rstrip("/")


_HELD: dict[str, SparkSession] = {}


def fresh_dir(spark: SparkSession, name: str) -> str:
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _HELD[path] = spark
    return path


def delete(path: str) -> None:
    spark = _HELD.pop(path, None)
    if spark is not None:
        there = spark._jvm.org.apache.hadoop.fs.Path(path)
        there.getFileSystem(spark._jsc.hadoopConfiguration()).delete(there, True)


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet in the shared folder and read back: its lineage is cut, and a lost
    executor costs a re-read instead of the whole computation."""
    spark = df.sparkSession
    path = fresh_dir(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._loam_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Deletes tables made by ``written`` that nothing will read again."""
    for df in tables:
        delete(df._loam_path)


@atexit.register
def _delete_all() -> None:
    for path in list(_HELD):
        with suppress(Exception):  # the session may have ended before
            delete(path)
