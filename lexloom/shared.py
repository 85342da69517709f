"""Tables in the folder that the driver and all executors share."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Written tables of this session, which go at its end at the latest.
_WRITTEN: set[str] = set()


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the folder that all executors share, spark.checkpoint.dir; a temporary one only where that is unset and the session runs in one process."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.conf.get("spark.master", "").startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = os.path.join(tempfile.gettempdir(), "checkpoints")
    path = f"{folder.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    if not _WRITTEN:
        atexit.register(_clear)
    _WRITTEN.add(path)
    return path


def written(df: DataFrame, name: str, by: str | None = None) -> DataFrame:
    """df as a table in the shared folder, partitioned by a column if one is given: a cut in the lineage that outlives executors, and the same rows for whatever reads it."""
    path = scratch(df.sparkSession, name)
    writer = df.write.option("compression", "zstd")
    (writer.partitionBy(by) if by else writer).parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._path = path
    return out


def dropped(*tables: DataFrame) -> None:
    """Delete written tables that nothing reads any more."""
    for df in tables:
        _delete(df.sparkSession, df._path)


def _delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(at, True)
    _WRITTEN.discard(path)


def _clear() -> None:
    spark = SparkSession.getActiveSession()
    for path in list(_WRITTEN) if spark else ():
        try:
            _delete(spark, path)
        except Exception:  # noqa: BLE001 - the session may have ended; the folder's owner clears it then
            return
