"""A data source for streams of length-delimited messages that are read in parts.

A stream has no marks to split it at, but its writer knows where messages begin: beside each file it leaves the places of some of them. The reader makes a task of each stretch between such places,
so that one file is many tasks; a file without an index is one. Very many small stretches are put together, neighbours of a file only, so that there are no more tasks than the bytes are worth.

    spark.dataSource.register(FrameSource)
    articles.write.format("frames").mode("append").save(path)
    spark.read.format("frames").load(path)
"""

from __future__ import annotations

import struct
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from .delimited import ARTICLE_FIELDS, _headed, decode, decode_all, encode_all, frames  # noqa: F401 - decode, for one message
from .schemas import ARTICLE

#: Bytes of a stretch, at least; messages of a batch of rows; messages that a writer encodes at a time; tasks that a reader has for small stretches, and bytes up to which it puts these together; the ending of an index file.
STRETCH, ROWS, SLICE, TASKS, TASK_BYTES, INDEX = 8 << 20, 256, 64, 256, 32 << 20, ".index"


def filesystem(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or URI, and the path there."""
    if path.startswith("file:"):
        path = "/" + path[5:].lstrip("/")
    if "://" in path:
        return fs.FileSystem.from_uri(path)
    return fs.LocalFileSystem(), path


@dataclass
class Stretch(InputPartition):
    """Bytes of a file, from one message's begin to another's."""

    file: str
    start: int
    end: int


@dataclass
class Written(WriterCommitMessage):
    names: list[str]


class FrameReader(DataSourceReader):
    def __init__(self, path: str, schema: StructType):
        self.path, self.schema = path, schema

    def partitions(self) -> list[InputPartition]:
        system, path = filesystem(self.path)
        info = system.get_file_info(path)
        infos = [info] if info.type == fs.FileType.File else system.get_file_info(fs.FileSelector(path))
        sizes = {i.path: i.size for i in infos if i.type == fs.FileType.File}
        found: list[InputPartition] = []
        least = min(TASK_BYTES, sum(size for file, size in sizes.items() if not file.endswith(INDEX)) // TASKS)
        for file, size in sorted(sizes.items()):
            if file.endswith(INDEX) or file.rsplit("/", 1)[-1].startswith(("_", ".")) or not size:
                continue
            places = [0]
            if file + INDEX in sizes or infos == [info] and system.get_file_info(file + INDEX).type == fs.FileType.File:
                with system.open_input_file(file + INDEX) as f:
                    raw = f.read()
                places = list(struct.unpack(f"<{len(raw) // 8}q", raw))
            begins = [0]
            for place in places[1:]:
                if place - begins[-1] >= least:
                    begins.append(place)
            found += [Stretch(file, a, b) for a, b in zip(begins, [*begins[1:], size])]
        return found

    def read(self, partition: Stretch | None) -> Iterator[pa.RecordBatch]:
        if partition is None:  # nothing to read
            return
        system, _ = filesystem(self.path)
        kind = to_arrow_schema(self.schema)
        with system.open_input_file(partition.file) as f:
            f.seek(partition.start)
            data = f.read(partition.end - partition.start)
        held: list[bytes] = []
        rows = lambda: pa.RecordBatch.from_struct_array(decode_all(held, ARTICLE_FIELDS, pa.struct(list(kind))))
        for frame in frames(data):
            held.append(frame)
            if len(held) == ROWS:
                yield rows()
                held.clear()
        if held:
            yield rows()


class FrameWriter(DataSourceArrowWriter):
    """Each task writes a file and its index under hidden names; the commit gives those of the tasks that counted their own."""

    def __init__(self, path: str, stretch: int, overwrite: bool):
        self.path, self.stretch, self.overwrite = path, stretch, overwrite

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        system, path = filesystem(self.path)
        system.create_dir(path, recursive=True)
        name = f"part-{uuid.uuid4().hex}"
        at, last, places = 0, 0, [0]
        with system.open_output_stream(f"{path}/_{name}") as f:
            for some in (b.slice(i, SLICE) for b in iterator for i in range(0, b.num_rows, SLICE)):
                bodies = _headed(encode_all(some.to_struct_array(), ARTICLE_FIELDS), b"")
                ends = at + np.cumsum(pc.binary_length(bodies).to_numpy())
                for end in ends.tolist():
                    if at - last >= self.stretch:
                        places.append(at)
                        last = at
                    at = end
                f.write(b"".join(bodies.to_pylist()))
        with system.open_output_stream(f"{path}/_{name}{INDEX}") as f:
            f.write(struct.pack(f"<{len(places)}q", *places))
        return Written([name, name + INDEX])

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        system, path = filesystem(self.path)
        system.create_dir(path, recursive=True)
        own = {n for m in messages if m for n in m.names}
        if self.overwrite:
            for info in system.get_file_info(fs.FileSelector(path)):
                if info.path.rsplit("/", 1)[-1].lstrip("_") not in own:
                    system.delete_file(info.path)
        for name in sorted(own, reverse=True):
            system.move(f"{path}/_{name}", f"{path}/{name}")

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        system, path = filesystem(self.path)
        for name in (n for m in messages if m for n in m.names):
            system.delete_file(f"{path}/_{name}")


class FrameSource(DataSource):
    """Options: path, and for writing stretch, the least bytes between two places of the index."""

    @classmethod
    def name(cls) -> str:
        return "frames"

    def schema(self) -> str:
        return ARTICLE

    def reader(self, schema: StructType) -> DataSourceReader:
        return FrameReader(self.options["path"], schema)

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        return FrameWriter(self.options["path"], int(self.options.get("stretch", STRETCH)), overwrite)
