"""Helpers shared by the training-data operators."""

from __future__ import annotations

import atexit
import ctypes
import os
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: The ASCII white space that separates words: space and \x09-\x0D.
WORD_PATTERN = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir. Where it is unset and the session runs in one process, as in tests, a temporary one;
    on a cluster no folder of one machine can take its place, so that it is an error there."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.conf.get("spark.master", "").startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        path = os.path.join(tempfile.gettempdir(), "checkpoints")
        os.makedirs(path, exist_ok=True)
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


#: Folders of written tables by session, which go at its end at the latest.
_WRITTEN: set[str] = set()


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write df as Parquet into the shared folder and read it back.

    Cuts the lineage, survives the loss of executors, and makes everything that reads the
    table see the same rows (also where df's partitioning isn't deterministic). discard() deletes it again; what is left goes when the driver ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    if not _WRITTEN:
        atexit.register(_clear)
    _WRITTEN.add(path)
    df.write.option("compression", "zstd").parquet(path)  # small, and without the direct buffers of other codecs
    out = spark.read.schema(df.schema).parquet(path)
    out._written = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete written tables that nothing reads any more; other DataFrames are left alone."""
    for df in tables:
        path = getattr(df, "_written", None)
        if path:
            _delete(df.sparkSession, path)


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


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


#: Rows of an Arrow batch that a worker turns into Python objects at a time.
SLICE_ROWS = 2_048


def frugal(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """run over small slices of the batches; what the worker has freed goes back to the system at the end, since workers stay."""

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batch.slice(i, SLICE_ROWS) for batch in batches for i in range(0, batch.num_rows, SLICE_ROWS))
        release()

    return over


def release() -> None:
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass
