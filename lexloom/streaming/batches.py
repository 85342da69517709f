"""Batches of requests over a stream: state that is flushed when it reaches a limit, or when its group has ended."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: Bytes of a file that arrives and of a micro-batch, on average, a text counting as ROW_BYTES more than it has: a worker holds the texts that a group has in a micro-batch.
FILE_BYTES, BATCH_BYTES, ROW_BYTES = 16 << 20, 128 << 20, 64

STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Batches(StatefulProcessor):
    """A group's open batch: how many characters it has, its number, and its texts, which are sent on together once the limit is reached; a timer sends the last ones."""

    def __init__(self, limit: int, gap_ms: int, kind: str):
        self.limit, self.gap_ms, self.kind = limit, gap_ms, kind

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.now = handle.getValueState("now", "size long, number int, latest long")
        self.texts = handle.getListState("texts", "ordinal long, text string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        size, number, latest = self.now.get() if self.now.exists() else (0, 0, 0)
        held = [tuple(t) for t in self.texts.get()] if size or self.texts.exists() else []
        arrived = pd.concat(rows).sort_values(["ordinal", "text"])
        for ordinal, text, at in zip(arrived["ordinal"], arrived["text"], arrived["at"]):
            held.append((int(ordinal), text))
            size += len(text or "")
            latest = max(latest, int(at.timestamp() * 1000))
            if size >= self.limit:
                yield self._row(key, number, held)
                size, number, held = 0, number + 1, []
        self._keep(size, number, latest, held)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        size, number, latest = self.now.get()
        held = [tuple(t) for t in self.texts.get()]
        if held:
            yield self._row(key, number, held)
        self.now.update((0, number + 1, latest))
        self.texts.clear()

    def _keep(self, size: int, number: int, latest: int, held: list[tuple]) -> None:
        self.now.update((size, number, latest))
        self.texts.clear()
        if held:
            self.texts.put(held)
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer if isinstance(timer, int) else timer[0])
        if held:
            self.handle.registerTimer(latest + self.gap_ms)

    def _row(self, key, number: int, held: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame({"group_id": [key[0]], "batch": [number], "ordinals": [[o for o, _ in held]], "texts": [[t for _, t in held]]})

    def close(self) -> None:
        pass


def batched(stream: DataFrame, limit: int, gap: str = "10 minutes", gap_ms: int = 600_000) -> DataFrame:
    """(group_id, batch, ordinals, texts): the texts of stream (group_id, ordinal, text, at) in batches of a group, each sent on once its characters reach the limit.

    A group's rows arrive in the order of their ordinals, or within one micro-batch; a worker holds those of one micro-batch, so that a source which has much to give needs a limit
    such as maxFilesPerTrigger, with files in that order: see arrive(). What is left goes when the watermark passes the group's last time by the gap; a group that goes on after that goes on
    with the next number. Rows later than the watermark are dropped, as everywhere. With a checkpoint, and a sink that counts a micro-batch once, a restart neither loses nor repeats any.
    """
    stream.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)
    kind = stream.schema["group_id"].dataType.simpleString()
    rows = stream.select("group_id", "ordinal", "text", "at").withWatermark("at", gap)
    return rows.groupBy("group_id").transformWithStateInPandas(
        statefulProcessor=Batches(limit, gap_ms, kind), outputStructType=f"group_id {kind}, batch int, ordinals array<bigint>, texts array<string>", outputMode="append", timeMode="eventTime"
    )


def arrive(rows: DataFrame, path: str, ordinal: str = "ordinal", text: str = "text") -> int:
    """Write rows as files of about FILE_BYTES for a stream that reads path, and return how many of them make a micro-batch, for maxFilesPerTrigger.

    A file has a range of ordinals, equal ones together, and files have their ordinals' order in their times, a second apart, in which a stream takes them. Where a store keeps times of its own,
    all files make one micro-batch.
    """
    spark = rows.sparkSession
    size = rows.agg(F.sum(F.coalesce(F.octet_length(text), F.lit(0)) + F.lit(ROW_BYTES).cast("long"))).first()[0] or 0
    rows.repartitionByRange(1 + size // FILE_BYTES, ordinal).write.parquet(path)
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())

    def listed() -> list:
        return sorted((f for f in system.listStatus(at) if f.getPath().getName().startswith("part-")), key=lambda f: f.getPath().getName())

    files = listed()
    last = max((f.getModificationTime() for f in files), default=0)
    times = [last - 1000 * (len(files) - k) for k in range(len(files))]
    for f, time in zip(files, times):
        system.setTimes(f.getPath(), time, -1)
    if [f.getModificationTime() // 1000 for f in listed()] != [time // 1000 for time in times]:
        return max(1, len(files))
    return max(1, min(len(files), BATCH_BYTES * len(files) // max(1, size)))
